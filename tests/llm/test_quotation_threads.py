"""Quotation linking against a version without Spark, on random threads."""

from __future__ import annotations

import random
import re

import pytest

from matchengine.llm import quotations

ATTRIBUTION = re.compile(r"(wrote|schrieb|écrit|escribió)[^:]{0,80}:\s*$", re.IGNORECASE)


def tidy(text):
    return " ".join(text.lower().split())


def read(text):
    """Own lines, and quoted passages as (level, lines)."""
    own, passages, last = [], [], 0
    for line in text.split("\n"):
        rest, level = line, 0
        while re.match(r"[ \t]*>", rest):
            rest, level = rest[rest.index(">") + 1 :], level + 1
        if level == 0:
            own.append(line)
        elif last == 0:
            while own and not own[-1].strip():
                own.pop()
            if own and ATTRIBUTION.search(own[-1]):
                own.pop()
        if level and level != last:
            passages.append((level, []))
        if level:
            passages[-1][1].append(tidy(rest))
        last = level
    return ("\n".join(own).strip("\n") if passages else text), passages


def brute(rows):
    """(conv, turn) to parent, first message, depth, path and own text."""
    out, parsed = {}, {}
    for conv, turn, text in rows:
        parsed[conv, turn] = read(text) if text is not None else (None, [])
    for conv, turn, text in sorted(rows, key=lambda r: r[1]):
        own, passages = parsed[conv, turn]
        offers = {}
        for (c, t), (said, _) in parsed.items():
            if c == conv and t < turn and said is not None:
                for piece in {tidy(x) for x in [said, *re.split(r"\n\s*\n", said), *said.split("\n")]} - {""}:
                    offers.setdefault(piece, []).append(t)
        found = []
        for level, lines in passages:
            whole = tidy(" ".join(lines))
            found += [(level, 0, -max(offers[whole]))] if whole in offers and whole else []
            found += [(level, 1, -max(offers[x])) for x in lines if x and x in offers]
        parent = -min(found)[2] if found else None
        path = [*out[conv, parent][3], turn] if parent is not None else [turn]
        out[conv, turn] = parent, path[0], len(path) - 1, path, own
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_threads(spark, seed):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "Ünï", "x"]
    said: dict[int, list[str]] = {}
    rows = []
    for conv in range(12):
        said[conv] = []
        for turn in range(rng.randint(1, 14)):
            lines = []
            for _ in range(rng.randint(0, 3)):
                if not said[conv] or rng.random() < 0.2:
                    lines.append(rng.choice(["> never said", ">", ">> > deep " + rng.choice(words)]))
                    continue
                quoted = rng.choice(said[conv]).split("\n")
                if rng.random() < 0.5:
                    quoted = [rng.choice(quoted)]
                if rng.random() < 0.4:
                    lines += ["", "On Monday X wrote:"]
                marks = rng.choice(["> ", ">", ">> ", " > > "])
                lines += [marks + (q.upper() if rng.random() < 0.3 else "  ".join(q.split(" "))) for q in quoted]
            lines += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 3))) + f" {conv} {turn}" for _ in range(rng.randint(0, 3))]
            if rng.random() < 0.2:
                lines.insert(len(lines) // 2, "")
            text = None if rng.random() < 0.03 else "\n".join(lines)
            rows.append((conv, turn, text))
            own = read(text)[0] if text else None
            if own and own.strip():
                said[conv].append(own)
    frame = spark.createDataFrame([(c, t, "user", x, "other", 3) for c, t, x in rows], "conv_id long, turn long, role string, text string, up string, depth int").repartition(4)
    found = quotations.link_quotations(frame)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.depth, list(r.reply_path), r.text) for r in found.collect()}
    want = brute(rows)
    assert got == want
    assert sum(w[0] is not None for w in want.values()) > 15 and max(w[2] for w in want.values()) > 2
    order = [(r.conv_id, r.turn) for r in quotations.format_chat(found).collect()]
    place = {key: k for k, key in enumerate(order)}
    for (conv, turn), (parent, *_rest) in want.items():
        assert parent is None or place[conv, parent] < place[conv, turn]
    # A branch is not interrupted by another one.
    for (conv, _), (_, _, _, path, _) in want.items():
        inside = sorted(place[key] for key, w in want.items() if key[0] == conv and w[3][: len(path)] == path)
        assert inside == list(range(inside[0], inside[0] + len(inside)))


def test_very_long_texts_and_repeated_rows(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, 0, "user", long), (1, 1, "user", "> " + long + "\nyes"), (1, 1, "user", "> " + long + "\nyes"), (1, 2, "user", ">" * 500 + " yes\nend")]
    found = sorted((r.turn, r.parent_turn, r.text) for r in quotations.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect() if r.turn)
    assert found == [(1, 0, "yes"), (1, 0, "yes"), (2, 1, "end")]
