"""Small results on the driver: configuration, JSON records, and reports as Markdown and HTML.

Everything here formats rows that are few by construction (a verdict, a manifest of a sample, a table of categories).
"""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenlake.operators.sampling import stratum_counts


def load_config(path: str | Path) -> dict:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading a YAML configuration needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f)


def write_json(value: Any, path: str | Path) -> None:
    """UTF-8, other than ASCII kept; folders are made."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def dropped_record(dropped: DataFrame, reason: str) -> DataFrame:
    """One row (n_dropped, reason, audio_ids) to be written as JSON by Spark: the list may be long."""
    return dropped.agg(F.count("*").alias("n_dropped"), F.lit(reason).alias("reason"), F.sort_array(F.collect_list("audio_id")).alias("audio_ids"))


def audit_manifest(sample: DataFrame, seed: int, edges=(2.0, 4.0, 6.0, 8.0, 10.0)) -> dict:
    """What was sampled, in the order of the sample (a few thousand clips). The counts use the same edges as the sample."""
    ids = [r.audio_id for r in sample.orderBy("sort_key", "audio_id").select("audio_id").collect()]
    counts = {f"{r.bucket}|{r.channel}": r.n for r in stratum_counts(sample, edges).collect()}
    return {"seed": seed, "n_sampled": len(ids), "audio_ids": ids, "stratum_counts": dict(sorted(counts.items()))}


def audit_report(verdict: dict, *, threshold: float = 5.0) -> str:
    """A verdict's row (wer and cer of both sides, deltas, lo, hi, n_clips) as Markdown."""
    line = lambda name, a, b, d: f"| {name} | {a:.2f} | {b:.2f} | {d:+.2f} |"
    rows = [line("WER", verdict["wer_orig"], verdict["wer_recon"], verdict["delta_wer"]), line("CER", verdict["cer_orig"], verdict["cer_recon"], verdict["delta_cer"])]
    where = "above" if verdict["lo"] > threshold else "below" if verdict["hi"] < threshold else "across"
    return "\n".join([f"# Codec audit: {verdict['verdict']}", "", f"{verdict['n_clips']} clips; the interval of the WER difference [{verdict['lo']:.2f}, {verdict['hi']:.2f}] lies {where} {threshold} points.", "", "| Rate | original | reconstruction | difference |", "|-|-|-|-|", *rows, ""])


def table_html(title: str, rows: list[dict], audio: str | None = None) -> str:
    """Rows as an HTML table, all text escaped; the column `audio` becomes a player."""
    names = list(rows[0]) if rows else []
    cell = lambda k, v: f'<td><audio controls src="{html.escape(str(v), quote=True)}"></audio></td>' if k == audio else f"<td>{html.escape('' if v is None else str(v))}</td>"
    body = "".join(f"<tr>{''.join(cell(k, r.get(k)) for k in names)}</tr>\n" for r in rows)
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{''.join(f'<th>{html.escape(n)}</th>' for n in names)}</tr>\n{body}</table>"


def dataset_card(release: DataFrame, *, title: str, source: str, license: str, codec: str = "a neural codec") -> str:
    """A release's card: front matter and its totals, from one row of aggregates."""
    from tokenlake.functions.arrays import VOCABULARY

    sums = release.agg(F.count("*").alias("n"), F.sum("duration").alias("seconds"), F.sum(F.size("tokens")).alias("tokens")).first()
    distinct = release.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t")).first()[0]
    size = next((name for most, name in ((1_000, "n<1K"), (10_000, "1K<n<10K"), (100_000, "10K<n<100K")) if sums.n < most), "100K<n<1M")
    front = ["---", f"license: {license}", "size_categories:", f"- {size}", "---"]
    facts = [f"{sums.n:,} clips, {(sums.seconds or 0) / 3600:.1f} hours, {sums.tokens or 0:,} tokens.", f"{distinct:,} of {VOCABULARY:,} codes occur ({100 * distinct / VOCABULARY:.1f} %).", f"Encoded with {codec} from {source}. Audio is not part of this release."]
    return "\n".join([*front, f"# {title}", "", *facts, ""])


def publish(release: DataFrame, path: str, *, title: str, source: str, license: str) -> str:
    """Write a release (`data`, Parquet) to a folder, read it again, validate it, and only then write its card there.

    Nothing is uploaded: pushing a folder to a hub is the caller's step.
    """
    from tokenlake.operators import validate

    release.write.mode("overwrite").parquet(f"{path}/data")
    spark = release.sparkSession
    got = validate.summary(validate.validate_parquet(spark, f"{path}/data")).first()
    if not got.ok:
        raise ValueError(f"{got.n_ok}/{got.n_rows} rows valid, {got.n_errors} errors: no card written")
    card = dataset_card(spark.read.parquet(f"{path}/data"), title=title, source=source, license=license)
    Path(path, "README.md").write_text(card, encoding="utf-8")
    return card
