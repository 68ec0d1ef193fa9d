"""Plain versions of the stages, for small inputs."""

from test_decontamination import brute as _tests
from test_near_dedup import brute as _near
from test_suffix_dedup import brute as _repeats


def near_groups(rows, words, percent):
    return {k: least for k, _, least in _near(rows, words, percent)}


def repeats(rows):
    return {r[0]: r[5] for r in _repeats(rows)}


def passage_hits(rows, items):
    return {k: hit for k, (_, hit, _) in _tests(rows, items).items()}
