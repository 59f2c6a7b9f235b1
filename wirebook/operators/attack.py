"""MITRE ATT&CK for ICS references on findings."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wirebook import catalog
from wirebook.functions.literals import lookup, string_array
from wirebook.functions.once import compute_once
from wirebook.operators.extensions import DEFAULT, Registry


def signal_index(techniques: DataFrame, order: list[catalog.Technique] = catalog.TECHNIQUES) -> DataFrame:
    """Techniques of each signal, in the order of a catalogue."""
    numbered = techniques.select(
        "technique_id", F.posexplode("detection_signals").alias("place", "signal")
    )
    place = lookup({t.technique_id: i for i, t in enumerate(order)}, F.col("technique_id"), "int")
    return numbered.groupBy("signal").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(place.alias("i"), "technique_id"))), lambda x: x["technique_id"]
        ).alias("technique_ids")
    )


def signals(category: Column, function_code: Column, avg_interval_ms: Column) -> Column:
    """Signals of a finding: its category, then what its attributes add."""
    writes = F.upper(function_code).isin(catalog.WRITE_FUNCTION_CODES)
    none = F.array().cast("array<string>")
    return F.concat(
        F.array(F.coalesce(lookup(catalog.CATEGORY_SIGNALS, category, "string"), category)),
        F.when(writes, string_array(["write_register", "unusual_function_code"])).otherwise(none),
        F.when(avg_interval_ms.isNotNull(), string_array(["interval_deviation"])).otherwise(none),
    )


class Catalogue(NamedTuple):
    """Techniques and tactics that findings refer to, and the signals of categories."""

    techniques: list[catalog.Technique] = catalog.TECHNIQUES
    tactics: list[catalog.Tactic] = catalog.TACTICS
    category_signals: dict[str, str] = catalog.CATEGORY_SIGNALS


def _by_signal(known: Catalogue) -> dict[str, list[catalog.Technique]]:
    index: dict[str, list[catalog.Technique]] = {}
    for technique in known.techniques:
        for signal in technique.detection_signals:
            index.setdefault(signal, []).append(technique)
    return index


_REFERENCES = (
    "struct<technique_ids:array<string>,tactic_ids:array<string>,"
    "techniques:array<struct<technique_id:string,name:string,tactic_id:string,tactic_name:string>>>"
)


def _reference(signals: list[str], known: Catalogue) -> dict:
    """What a finding with these signals refers to, in order, each once."""
    index = _by_signal(known)
    tactic_names = {t.tactic_id: t.name for t in known.tactics}
    found = {t.technique_id: t for s in signals for t in index.get(s, [])}
    return {
        "technique_ids": list(found),
        "tactic_ids": list(dict.fromkeys(t.tactic_id for t in found.values())),
        "techniques": [
            {
                "technique_id": t.technique_id,
                "name": t.name,
                "tactic_id": t.tactic_id,
                "tactic_name": tactic_names.get(t.tactic_id, "Unknown"),
            }
            for t in found.values()
        ],
    }


def _references(signal: Column, extra: list[str], known: Catalogue) -> Column:
    """References of a main signal together with extra signals."""
    # Constant text: parsed once, when the plan is optimized.
    found = {s: _reference([s, *extra], known) for s in _by_signal(known)}
    table = F.from_json(F.lit(json.dumps(found)), f"map<string,{_REFERENCES}>")
    none = F.from_json(F.lit(json.dumps(_reference(extra, known))), _REFERENCES)
    return F.coalesce(F.try_element_at(table, signal), none)


def enrich(findings: DataFrame, known: Catalogue = Catalogue(), registry: Registry = DEFAULT) -> DataFrame:
    """Add technique_ids, tactic_ids and techniques to a findings table.

    ``known`` replaces the catalogue of techniques; added detections refer to
    techniques by their signals.

    What a finding refers to depends on its category and on two properties:
    whether it writes and whether it has an interval.  Every combination is
    worked out beforehand and kept as a literal, so a row costs one lookup.
    """
    have = set(findings.columns)
    category = F.col("category")
    signal = F.coalesce(lookup(known.category_signals | registry.signals, category, "string"), category)
    writes, timed = F.lit(False), F.lit(False)
    if "function_code" in have:
        writes = F.coalesce(F.upper("function_code").isin(catalog.WRITE_FUNCTION_CODES), F.lit(False))
    if "avg_interval_ms" in have:
        timed = F.col("avg_interval_ms").isNotNull()
    by_write, by_time = ["write_register", "unusual_function_code"], ["interval_deviation"]
    references = (
        F.when(writes & timed, _references(signal, [*by_write, *by_time], known))
        .when(writes, _references(signal, by_write, known))
        .when(timed, _references(signal, by_time, known))
        .otherwise(_references(signal, [], known))
    )
    return compute_once(findings, attack=references).select(*findings.columns, "attack.*")


def summary_by_tactic(enriched: DataFrame, known: Catalogue = Catalogue()) -> DataFrame:
    """Findings per tactic; a finding counts once under each of its tactics."""
    names = {t.tactic_id: t.name for t in known.tactics}
    tactic = F.coalesce(lookup(names, F.col("tactic_id"), "string"), F.col("tactic_id"))
    return (
        enriched.select(F.explode("tactic_ids").alias("tactic_id"))
        .groupBy(tactic.alias("tactic"))
        .agg(F.count("*").alias("findings"))
    )


def ensure_named(seed: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    """Merge tactics or techniques by id; a known row takes only the name."""
    if existing is None:
        return seed
    old, new = existing.alias("old"), seed.alias("new")
    known = F.col(f"old.{key}").isNotNull()

    def column(name: str) -> Column:
        if name in (key, "name"):
            return F.coalesce(f"new.{name}", f"old.{name}").alias(name)
        return F.when(known, F.col(f"old.{name}")).otherwise(F.col(f"new.{name}")).alias(name)

    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full").select(*[column(c) for c in seed.columns])


def technique_tactics(techniques: DataFrame, tactics: DataFrame) -> DataFrame:
    """Links (technique_id, tactic_id) whose tactic exists."""
    return techniques.select("technique_id", "tactic_id").join(tactics.select("tactic_id"), "tactic_id", "left_semi")
