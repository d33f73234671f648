"""False-positive baseline from control features."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .results import one_direction

MODES = ("exact", "prefix", "suffix", "contains")
UNION = "any_control"


def parse_rules(rules: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str]]]:
    """(group, mode, text) rules by group, in order of first mention."""
    out: dict[str, list[tuple[str, str]]] = {}
    for group, mode, text in rules:
        if not group or not text:
            raise ValueError("a control rule has an empty group or text")
        if group == UNION:
            raise ValueError(f"{UNION} is reserved")
        if mode not in MODES:
            raise ValueError(f"a rule's mode must be one of {', '.join(MODES)}")
        out.setdefault(group, []).append((mode, text))
    if not out:
        raise ValueError("no control rule is given")
    return out


def matches(name: Column, rules: list[tuple[str, str]], ignore_case: bool = False) -> Column:
    """Whether a name fits any rule; texts are literal. Case is ignored by lower-casing."""
    own = F.lower(name) if ignore_case else name
    tests = {"exact": lambda t: own == t, "prefix": own.startswith, "suffix": own.endswith, "contains": own.contains}
    return reduce(or_, [tests[m](t.lower() if ignore_case else t) for m, t in rules])


def control_baseline(results: DataFrame, rules: list[tuple[str, str, str]], thresholds: list[float], keep: str = "last", ignore_case: bool = False) -> DataFrame:
    """A row for each threshold and group (and for all groups together, if several): how many significant pairs have a control.

    Matched features are counted over both genes of all raw rows, pairs after one direction is kept. One pass over each.
    """
    groups = parse_rules(rules)
    if not thresholds or len(set(thresholds)) < len(thresholds):
        raise ValueError("thresholds must be given, and none twice")
    names = list(groups)
    every = [r for g in groups.values() for r in g]
    sets = [(g, groups[g]) for g in names] + ([(UNION, every)] if len(names) > 1 else [])
    features = results.select(F.col("gene_A").alias("g")).union(results.select("gene_B")).distinct()
    found = features.agg(*[F.count_if(matches(F.col("g"), r, ignore_case)).alias(f"f{k}") for k, (_, r) in enumerate(sets)])
    both = lambda r: matches(F.col("gene_A"), r, ignore_case) | matches(F.col("gene_B"), r, ignore_case)
    aggs = []
    for t, threshold in enumerate(thresholds):
        sure = F.col("qvalue_BH") < threshold
        aggs.append(F.count_if(sure).alias(f"t{t}"))
        aggs += [F.count_if(sure & both(r)).alias(f"c{t}_{k}") for k, (_, r) in enumerate(sets)]
    row = one_direction(results, keep).agg(*aggs).crossJoin(found)
    lines = [
        F.struct(F.lit(float(x)).alias("qvalue_threshold"), F.col(f"t{t}").alias("total_significant_pairs"), F.lit(g).alias("control_group"), F.col(f"c{t}_{k}").alias("control_associated_pair_count"), F.col(f"f{k}").alias("matched_control_feature_count"))
        for t, x in enumerate(thresholds)
        for k, (g, _) in enumerate(sets)
    ]
    out = row.select(F.explode(F.array(*lines)).alias("r")).select("r.*")
    share = F.when(F.col("total_significant_pairs") > 0, F.col("control_associated_pair_count") / F.col("total_significant_pairs"))
    return out.select("qvalue_threshold", "total_significant_pairs", "control_group", "control_associated_pair_count", share.alias("control_associated_pair_fraction"), (share * 100).alias("control_associated_percentage"), "matched_control_feature_count")
