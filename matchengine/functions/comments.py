"""What a comment says of adopted values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words by which comments say where a value is from.
FROM = r"FROM (?:THE )?ADOPTED"
IN = r"ADOPTED IN (?:THE )?ADOPTED"
#: First words of a sentence that argues for a value of its own.
ARGUED = r"^(?:PROPOSED|DEDUCED|BASED|IMPLIED|SPIN FROM|PARITY FROM)"
#: Of comments on differences or comments, and on placements in a level scheme.
DIFFERENT = "DIFFERENT|CONTRADICT"
PLACED = "LEVEL SCHEME|PLACE|POPULAT|CORRESPOND"
#: Multipolarities that a comment may give; longer names stand first, as the search takes
#: the first that fits.
MULTS = ("M1+E2", "E2+M1", "E1+M2", "M2+E1", "M2+E3", "E3+M2", "D+Q", "Q+D", "Q+O", "M1", "M2", "M3", "E1", "E2", "E3", "D", "Q", "O")


def _plain(body: Column) -> Column:
    return F.upper(F.trim(F.coalesce(body, F.lit(""))))


def _parts(body: Column) -> Column:
    """Clauses between full stops and semicolons that are not inside numbers."""
    return F.split(body, r"(?:\.(?![0-9])|;)+")


def says_from_adopted(body: Column, head: Column) -> Column:
    """Whether the comment says that a value is quoted from the adopted dataset.

    The first clause that says something decides: quoted, unless values are
    given, or the clause is about comments, differences, placements or a level
    scheme, or (head M) names a multipolarity of its own.
    """
    s = _plain(body)
    first = F.regexp_extract(s, r"(?s)^(.*?)(?:\.(?=\s|$)|$)", 1)

    def verdict(part: Column) -> Column:
        from_ = part.rlike(FROM)
        before = F.when(from_, F.regexp_extract(part, rf"(?s)^(.*?){FROM}", 1)).otherwise(F.regexp_extract(part, rf"(?s)^(.*?){IN}", 1))
        rest = F.when(from_, F.regexp_replace(part, FROM, " ")).otherwise(F.regexp_replace(part, IN, " "))
        silent = ~rest.rlike("[0-9]")
        other = rest.contains("COMMENT") | (from_ & (rest.rlike(DIFFERENT) | before.rlike(PLACED)))
        own = (head == "M") & F.regexp_replace(rest, r"MULT|[=()]", "").rlike(r"(?:^|[,\s])(?:D|Q|D\+Q|Q\+D)(?:$|[,\s])")
        said = F.when(other | own, -1).otherwise(1)
        return (
            F.when(~part.contains("ADOPTED"), 0)
            .when(from_, F.when(silent, said).otherwise(0))
            .when(part.rlike(rf"NOT {IN}"), -1)
            .when(part.rlike(IN), F.when(silent, said).otherwise(0))
            .when(part.contains("SAME") & ~part.contains("NOT ") & ~part.contains("EXCEPT"), 1)
            .otherwise(0)
        )

    decided = F.filter(F.transform(_parts(first), lambda p: verdict(F.trim(p))), lambda v: v != 0)
    return (
        F.when(~s.contains("ADOPTED"), False)
        .when(s.rlike(f"^{FROM}"), True)
        .when(first.rlike(ARGUED), False)
        .when(first.rlike(r"^FROM \{?\+?[0-9]+\}?[A-Z]{1,2} ADOPTED"), True)
        .otherwise(F.coalesce(F.get(decided, 0) > 0, F.lit(False)))
    )


def _multipolarity(text: Column) -> Column:
    names = "|".join(m.replace("+", r"\+") for m in MULTS)
    return F.regexp_extract(F.regexp_replace(text, "MULT|[=:]", " "), rf"(?:^|\s)((?:\(|\[)?(?:{names})(?:\)|\])?)(?=\s|$)", 1)


def _spin_parity(text: Column) -> Column:
    one = r"\(?[0-9]+(?:/2)?\)?(?:\(?[-+]\)?)?"
    return F.regexp_extract(text, rf"(?:^|[\s=])({one}(?:,{one})*\)?(?:\(?[-+]\)?)?)(?=[\s,]|$)", 1)


def _number(text: Column) -> Column:
    """A value, with its unit and uncertainty if they follow."""
    found = F.regexp_extract(F.regexp_replace(text, r"\{I([0-9]+)\}", "$1"), r"(?:^|[\s=(])([-+]?[0-9]+(?:\.[0-9]*)?(?:E[-+]?[0-9]+)?(?:\s+[A-Z%]{1,3})?(?:\s+[0-9]+)?)(?=[\s,)]|$)", 1)
    return F.trim(found)


def adopted_value(body: Column, head: Column) -> Column:
    """The value that a comment gives as the adopted one; empty if none.

    ``head`` chooses the kind: M a multipolarity, J a spin-parity, else a number.
    """

    def clause(part: Column) -> Column:
        quoted = F.regexp_extract(part, rf"(?s)^(.*?){FROM}\s+(?:LEV|GAM|DATA)", 1)
        taken = F.regexp_extract(part, r"(?s)^(.*?)(?:ADOPTED )?IN (?:THE )?ADOPTED", 1)
        stated = F.regexp_extract(part, r"(?s)ADOPTED (?:VALUE|ASSIGNMENT)(?: IS|:|=)\s*(?:PRELIMINARILY|PRELIMINARY|TENTATIVELY|TENTATIVE)?\s*(.*)$", 1)
        stated = F.when(stated.rlike("^(?:DEDUCED|FROM|WEIGHTED|UNWEIGHTED|SUM|CALCULATED)"), "").otherwise(stated)
        source = F.when(~part.contains("ADOPTED"), "").when(part.rlike(FROM), quoted).when(part.rlike(r"IN (?:THE )?ADOPTED"), taken).otherwise(stated)
        source = F.when(head.isin("J", "T") & part.contains("ADOPTED GAMMAS"), "").otherwise(source)
        return F.when(head == "M", _multipolarity(source)).when(head == "J", _spin_parity(source)).otherwise(_number(source))

    found = F.filter(F.transform(_parts(_plain(body)), lambda p: clause(F.trim(p))), lambda v: v != "")
    return F.coalesce(F.get(found, 0), F.lit(""))
