"""Record types and the scoring constants, in one place."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

SPIN_OPTIONS = "array<struct<twoTimesSpin:int,isTentativeSpin:boolean,parity:string,isTentativeParity:boolean>>"
GAMMAS = "array<struct<energy:double,energy_uncertainty:double,intensity:double,intensity_uncertainty:double>>"
LEVELS = f"dataset_code string, level_index int, level_id string, energy_value double, energy_uncertainty double, spin_parity_list {SPIN_OPTIONS}, spin_parity_string string, gamma_decays {GAMMAS}"
EDGES = "level_1_id string, level_2_id string, dataset_code_1 string, dataset_code_2 string, energy double, spin double, parity double, specificity double, gamma double, probability double, pair_rank int"

_MEASURE = "struct<unit:string,value:double,uncertainty:struct<value:double,type:string>,evaluatorInput:string>"
_LEVEL = f"struct<energy:{_MEASURE},isStable:boolean,spinParity:struct<values:{SPIN_OPTIONS},evaluatorInput:string>,gammas:array<int>>"
_GAMMA = f"struct<energy:{_MEASURE},gammaIntensity:struct<value:double,uncertainty:struct<value:double,type:string>,evaluatorInput:string>,initialLevel:int,finalLevel:int>"
DATASET = f"levelsTable struct<levels:array<{_LEVEL}>>, gammasTable struct<gammas:array<{_GAMMA}>>"


@dataclass(frozen=True)
class MatchConfig:
    """Scores, cuts and thresholds of matching (fixed values)."""

    sigma_scale: float = 0.1
    spin_match_firm: float = 1.0
    spin_match_tentative: float = 0.8
    spin_adjacent_firm: float = 0.05
    spin_adjacent_tentative: float = 0.2
    spin_far: float = 0.0
    parity_match_firm: float = 1.0
    parity_match_tentative: float = 0.8
    parity_mismatch_firm: float = 0.0
    parity_mismatch_tentative: float = 0.05
    specificity: str = "sqrt"
    specificity_alpha: float = 0.5
    correlation_threshold: float = 0.85
    correlation_exponent: float = 0.5
    neutral: float = 0.5
    neutral_confidence: float = 0.85
    spin_veto: float = 0.05
    parity_veto: float = 0.025
    most: float = 0.99
    energy_z: float = 3.0
    intensity_z: float = 3.0
    default_uncertainty: float = 5.0
    pair_threshold: float = 0.001
    merge_threshold: float = 0.15
    gamma_grid: tuple[float, ...] = field(default=(0.0, 0.3, 0.5, 0.7, 0.85, 0.9, 1.0))

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> MatchConfig:
        """Settings as ``to_json`` wrote them; absent ones keep their default,
        unknown ones are an error."""
        read = json.loads(text)
        if "gamma_grid" in read:
            read["gamma_grid"] = tuple(read["gamma_grid"])
        return cls(**read)


CONFIG = MatchConfig()
