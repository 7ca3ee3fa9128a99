"""From documents to validated shards: run, capacity, allocate, validate."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.tokenizers import CodePoints, Tokenizer
from ..operators import boilerplate, dedup, filters, pack, schedule, validate
from ..runtime import written
from .manifest import content_id, digest, reject_absolute_paths, validate_shards, write_json_atomic, write_shards


REPORT = "boilerplate_report.json"


class ReviewRequired(RuntimeError):
    """The boilerplate decision of a data set is still pending (exit code 20)."""

    exit_code = 20


@dataclass(frozen=True)
class Profile:
    train_sequences: int
    eval_sequences: int
    candidate_documents: int


DECISIONS = ("keep", "remove_exact", "pending")
#: Lines shorter than this go before boilerplate is looked for.
LINE_CHARACTERS = 40
PROFILES = {"smoke": Profile(8, 2, 128), "mvp": Profile(256, 32, 4096)}


@dataclass(frozen=True)
class Spec:
    """One preparation: documents are rows (position, text, source_ref).

    The line filter and the boilerplate decision also need ``domain``, the page filters
    ``title, url_final, url, status, text_md5, same_as``.  ``line_characters`` is 40 by default
    where boilerplate is decided on, and no line is dropped under ``keep``.
    """

    dataset_id: str
    profile: str = "smoke"
    seed: int = 42
    min_characters: int = 1
    policy: str = "preserve"
    clean_passes: int = 1
    decision: str = "keep"  # keep, remove_exact or pending
    profiles: dict[str, Profile] = field(default_factory=lambda: dict(PROFILES))
    line_characters: int | None = None
    rules: boilerplate.Rules = boilerplate.Rules()
    page_markers: dict[str, list[str]] | None = None  # arguments of filters.PageRules

    def __post_init__(self):
        if self.decision not in DECISIONS:
            raise ValueError(f"the decision must be one of {', '.join(DECISIONS)}, not {self.decision}")

    @property
    def least_line(self) -> int:
        if self.line_characters is not None:
            return self.line_characters
        return 0 if self.decision == "keep" else LINE_CHARACTERS

    @property
    def reviews(self) -> bool:
        """Lines or boilerplate are looked at."""
        return self.decision != "keep" or self.least_line > 0

    @property
    def columns(self) -> list[str]:
        """What the documents need beside position, text and source_ref."""
        pages = ["title", "url_final", "url", "status", "text_md5", "same_as"] if self.page_markers is not None else []
        return (["domain"] if self.reviews else []) + pages

    @property
    def budget(self) -> Profile:
        if self.profile not in self.profiles:
            raise ValueError(f"{self.dataset_id} defines no profile {self.profile}")
        return self.profiles[self.profile]

    def resolved(self) -> dict:
        parts = {k: v for k, v in asdict(self).items() if k not in ("profiles", "line_characters", "rules", "page_markers")}
        if self.reviews:
            parts |= {"line_characters": self.least_line, "rules": asdict(self.rules)}
        if self.page_markers is not None:
            parts["page_markers"] = {k: list(v) for k, v in self.page_markers.items()}
        return parts | {"budget": asdict(self.budget)}


def require_columns(documents: DataFrame, spec: Spec) -> None:
    missing = [c for c in spec.columns if c not in documents.columns]
    if missing:
        raise ValueError(f"{spec.dataset_id}: documents lack {', '.join(missing)}")


def eligible(documents: DataFrame, spec: Spec) -> DataFrame:
    """Documents that pass the page filters, where the spec has them."""
    if spec.page_markers is None:
        return documents
    pages = filters.PageRules(**spec.page_markers)
    rows = documents.filter(filters.first_reason(filters.page_reasons()).isNull())
    return rows.filter(pages.column(F.col("title"), F.col("url_final"), F.col("url")).isNull())


def reviewed(candidates: DataFrame, spec: Spec) -> tuple[DataFrame, dict | None]:
    """Candidates after the line filter and the boilerplate decision, and the report on them.

    The report says what removal takes from the candidates, whether or not it is done.
    Repeats are counted before duplicates go.  A document without domain is a domain of its own.
    """
    if not spec.reviews:
        return candidates, None
    dedup.require_unique(candidates, ["source_ref"], "the source reference of documents")
    domain = F.coalesce(F.nullif(filters.stripped(F.col("domain")), F.lit("")), F.concat(F.lit("\x00"), "source_ref"))
    docs = written(candidates.select("position", "source_ref", domain.alias("domain"), tx.cleaned(F.col("text")).alias("text")), "review-cleaned")
    lines = written(filters.short_line_filter(docs, "source_ref", "text", spec.least_line, spec.rules.min_after, spec.rules.max_removed), "review-lines")
    counts = lines.agg(
        F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"), F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed"),
        F.count_if("discarded_empty").alias("discarded_empty"), F.count_if("discarded_short").alias("discarded_short"), F.count_if("discarded_fraction").alias("discarded_fraction"), F.count_if("kept").alias("documents_kept"),
    ).first()
    left = docs.select("position", "source_ref", "domain").join(lines.filter("kept").select("source_ref", "text"), "source_ref")
    left = written(left.withColumnRenamed("source_ref", "doc"), "review-left")
    report = {
        "dataset_id": spec.dataset_id, "profile": spec.profile, "decision": spec.decision, "rules": asdict(spec.rules), "line_filter": {"line_characters": spec.least_line} | counts.asDict(),
        "removal": boilerplate.report(left, spec.rules).first().asDict(), "applied": spec.decision == "remove_exact", "finalization_blocked": spec.decision == "pending",
    }
    if spec.decision == "remove_exact":
        gone = written(boilerplate.removed(left, spec.rules).filter("kept").select("doc", "text"), "review-removed")
        again = written(gone.select("doc", tx.cleaned(F.col("text")).alias("text")).filter("text <> ''"), "review-again")
        left = left.drop("text").join(again, "doc")
    return left.select("position", "text", F.col("doc").alias("source_ref")), report


def survivors(documents: DataFrame, spec: Spec) -> DataFrame:
    """(dataset_id, source_hash, position, text): cleaned, long enough, first of its text."""
    text = tx.cleaned(F.col("text"), policy=spec.policy, passes=spec.clean_passes)
    rows = documents.select(F.lit(spec.dataset_id).alias("dataset_id"), F.sha2("source_ref", 256).alias("source_hash"), "position", text.alias("text"))
    rows = written(rows.filter(F.length("text") >= max(1, spec.min_characters)), "survivors")
    kept = dedup.keep_first(rows, ["dataset_id"], F.col("text"), "position")
    dedup.require_unique(kept, ["source_hash"], "the source reference of documents")
    return kept


#: The tokenizer where none is given.
CODE_POINTS = CodePoints()


def records_of(kept: DataFrame, tokenizer: Tokenizer = CODE_POINTS) -> DataFrame:
    return kept.select("dataset_id", "source_hash", tokenizer.count(F.col("text")).alias("n"))


def source_digest(documents: DataFrame, columns: list[str] = []) -> str:
    """Identity of an input relation, whatever the order of its rows."""
    row = documents.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("position", "source_ref", "text", *columns).cast("decimal(38,0)")).alias("s")).first()
    return digest([row["n"], str(row["s"])])


def run(spark: SparkSession, documents: DataFrame, spec: Spec, root: str, tokenizer: Tokenizer = CODE_POINTS, source: str | None = None, metrics: dict[str, int] | None = None) -> dict:
    """Prepares a data set below ``root`` and returns its manifest.

    The manifest is written last; where it exists, it is validated and returned.
    A pending decision leaves the boilerplate report below ``root``, if there are domains.
    ``source`` identifies the documents where their source does; ``metrics`` are kept in the manifest.
    """
    if spec.decision == "pending" and "domain" not in documents.columns:
        raise ReviewRequired(f"{spec.dataset_id} (no report without domain)")
    require_columns(documents, spec)
    source = source or source_digest(documents, spec.columns)
    ident = content_id(config=spec.resolved(), source=source, tokenizer=tokenizer.fingerprint())
    folder = os.path.join(root, spec.dataset_id, ident)
    path = os.path.join(folder, "dataset_manifest.json")
    if os.path.exists(path):
        return validate_preparation(spark, folder)
    candidates, report = reviewed(eligible(documents, spec).orderBy("position").limit(spec.budget.candidate_documents), spec)
    if report:
        reject_absolute_paths(report)
        write_json_atomic(os.path.join(folder, REPORT), report)
    if spec.decision == "pending":
        raise ReviewRequired(f"{spec.dataset_id} (see {spec.dataset_id}/{ident}/{REPORT})")
    kept = written(survivors(candidates, spec), "kept")
    placed = written(pack.placed(pack.split_by_budget(records_of(kept, tokenizer), spec.budget.eval_sequences, spec.seed), spec.seed), "placed")
    limits = {"train": spec.budget.train_sequences, "eval": spec.budget.eval_sequences}
    tails = pack.tails(placed, limits=limits)
    pack.require_budget(tails, limits)
    ids = kept.select("dataset_id", "source_hash", tokenizer.ids(F.col("text")).alias("input_ids"))
    rows = written(pack.sequence_ids(pack.sequences(pack.pieces(placed, limits=limits), ids)), "sequences")
    validate.require_valid(rows)
    shards = {split: write_shards(rows.filter(F.col("split") == split), os.path.join(folder, split)) for split in ("train", "eval")}
    manifest = {
        "dataset_id": spec.dataset_id, "profile": spec.profile, "preparation_id": ident, "resolved_config_sha256": digest(spec.resolved()), "source_digest": source, "tokenizer": {"name": tokenizer.name, "fingerprint_sha256": tokenizer.fingerprint()}, "scan_metrics": metrics or {},
        "counts": {split: sum(s["rows"] for s in shards[split]) for split in shards}, "discards": {r["split"]: {"not_selected": r["not_selected"], "tail": r["tail"]} for r in tails.collect()}, "shards": shards,
    }
    if report:
        manifest["boilerplate_report_sha256"] = digest(report)
    reject_absolute_paths(manifest)
    write_json_atomic(path, manifest)
    return validate_preparation(spark, folder)


def prepare(spark: SparkSession, configs: str, dataset_id: str, profile: str, data: str, root: str, tokenizer: Tokenizer = CODE_POINTS) -> dict:
    """From the files of a source to validated shards, as its configuration says."""
    from ..sources import adapters
    from . import config

    resolved, _ = config.load(configs, dataset_id, profile)
    root = config.output_root(root, data)
    spec = config.spec_of(resolved)
    cache = StageCache(root, dataset_id, {"scan": config.scan_digest(resolved)})
    guard = adapters.guard_of(data, resolved)
    if (kept := cache.get(spark, "documents", guard)) is None:
        scan = adapters.adapter_of(dataset_id).scan(spark, data, resolved)
        kept = cache.put(scan.documents, "documents", {"source": guard, "source_sha256": scan.source_sha256, "metrics": scan.metrics, "capped": scan.capped})
    documents, side = kept
    manifest = run(spark, documents, spec, root, tokenizer, side["source_sha256"], side["metrics"])
    cache.clear()
    return manifest


def validate_preparation(spark: SparkSession, folder: str) -> dict:
    """Raises unless files, rows, counts, splits and discards agree with the manifest."""
    with open(os.path.join(folder, "dataset_manifest.json"), encoding="utf-8") as f:
        manifest = json.load(f)
    reject_absolute_paths(manifest)
    stored = {"train", "eval", "dataset_manifest.json"} | ({REPORT} if "boilerplate_report_sha256" in manifest else set())
    surplus = set(os.listdir(folder)) - stored
    if REPORT in stored:
        with open(os.path.join(folder, REPORT), encoding="utf-8") as f:
            if digest(json.load(f)) != manifest["boilerplate_report_sha256"]:
                raise ValueError("the boilerplate report differs from the manifest")
    if surplus or manifest["preparation_id"] != os.path.basename(folder):
        raise ValueError("files or identity of the preparation don't match")
    rows = None
    for split, records in manifest["shards"].items():
        validate_shards(spark, os.path.join(folder, split), records)
        if sum(r["rows"] for r in records) != manifest["counts"][split]:
            raise ValueError(f"{split}: rows of the shards don't add up")
        part = spark.read.parquet(os.path.join(folder, split)).withColumn("split", F.lit(split))
        rows = part if rows is None else rows.unionByName(part)
    validate.require_valid(rows)
    if not validate.shared_sources(rows).isEmpty():
        raise ValueError("a source is in both splits")
    for split, d in manifest["discards"].items():
        if not 0 <= d["tail"] < pack.SEQUENCE or d["not_selected"] < d["tail"] or (d["not_selected"] - d["tail"]) % pack.SEQUENCE:
            raise ValueError(f"{split}: discards don't add up")
    return manifest


#: Every document is a candidate.
ALL = "all"


def capacity(documents: DataFrame, spec: Spec, record_capped: bool = False, eval_reserve: int = 256, candidate_documents: int | str | None = None, tokenizer: Tokenizer = CODE_POINTS) -> dict:
    """Sequences a data set can give beside the evaluation reserve.

    ``candidate_documents`` overrides the profile's number; ``ALL`` is no limit.
    ``exact`` if every document was looked at, else ``lower_bound``.
    """
    wanted = spec.budget.candidate_documents if candidate_documents is None else candidate_documents
    if wanted != ALL and (isinstance(wanted, bool) or not isinstance(wanted, int) or wanted < 1):
        raise ValueError(f"candidate documents must be a positive number or {ALL}, not {wanted!r}")
    require_columns(documents, spec)
    if spec.decision == "pending":
        raise ReviewRequired(spec.dataset_id)
    seen = eligible(documents, spec)
    if wanted != ALL:
        seen = seen.orderBy("position").limit(wanted)
    report = pack.capacity(pack.split_by_budget(records_of(survivors(reviewed(seen, spec)[0], spec), tokenizer), eval_reserve, spec.seed), eval_reserve).first()
    n = seen.count()
    found = {"dataset_id": spec.dataset_id, "capacity_kind": "exact" if (wanted == ALL or n < wanted) and not record_capped else "lower_bound", "candidate_documents": wanted, "documents": n, "train_sequences": report["train_sequences"] if report else 0, "eval_reserved": bool(report and report["eval_reserved"])}
    if not found["eval_reserved"]:
        raise ValueError(f"{spec.dataset_id} can't reserve {eval_reserve} evaluation sequences")
    return found | {"capacity_report_id": content_id(**found)}


def require_report(report: dict) -> None:
    """Raises unless a capacity report has its keys, plausible values and its own identity."""
    kinds = {"dataset_id": str, "capacity_kind": str, "documents": int, "train_sequences": int, "eval_reserved": bool, "capacity_report_id": str}
    wrong = [k for k, kind in kinds.items() if type(report.get(k)) is not kind]
    if wrong or report["capacity_kind"] not in ("exact", "lower_bound") or min(report["documents"], report["train_sequences"]) < 0 or not report["eval_reserved"]:
        raise ValueError(f"no capacity report: {', '.join(wrong) or report.get('dataset_id')}")
    if content_id(**{k: v for k, v in report.items() if k != "capacity_report_id"}) != report["capacity_report_id"]:
        raise ValueError(f"the capacity report of {report['dataset_id']} was changed")


def require_allocation(allocation: dict, reports: list[dict]) -> None:
    """Raises unless an allocation is the one that these reports give."""
    if allocation != allocate(reports, allocation["target"]):
        raise ValueError("the allocation isn't that of the reports")


def allocate(reports: list[dict], target: int) -> dict:
    """Training sequences of each data set, whatever the order of the reports."""
    for report in reports:
        require_report(report)
    if target % 8:
        raise ValueError("the target must be a multiple of 8")
    by_name = {r["dataset_id"]: r for r in sorted(reports, key=lambda r: r["dataset_id"])}
    if len(by_name) != len(reports):
        raise ValueError("one report per data set")
    have = {k: r["train_sequences"] for k, r in by_name.items()}
    if sum(have.values()) < target:
        kinds = {r["capacity_kind"] for r in reports}
        raise ValueError(f"{'lower bounds' if 'lower_bound' in kinds else 'exact capacities'} don't suffice: available_sequences={sum(have.values())} maximum_optimizer_steps={sum(have.values()) // 8}")
    out = {"target": target, "sequences": schedule.waterfill(have, target), "reports": {k: r["capacity_report_id"] for k, r in by_name.items()}}
    return out | {"allocation_sha256": digest(out)}


def resolve_inputs(root: str, names: list[str], profile: str, config_sha256: dict[str, str] | None = None) -> dict[str, dict]:
    """The one manifest of each data set and profile below a root."""
    found = {}
    for name in names:
        hits = []
        base = os.path.join(root, name)
        for ident in sorted(os.listdir(base)) if os.path.isdir(base) else []:
            path = os.path.join(base, ident, "dataset_manifest.json")
            if os.path.exists(path):
                with open(path, encoding="utf-8") as f:
                    m = json.load(f)
                if m["profile"] == profile and (not config_sha256 or m["resolved_config_sha256"] == config_sha256.get(name)):
                    hits.append(m)
        if len(hits) != 1:
            raise ValueError(f"{name}: expected one preparation, found {len(hits)}")
        found[name] = hits[0]
    return found


class StageCache:
    """Tables kept between runs under the digest of what made them, with a sidecar that is written
    last: a run that was stopped at its review or before its end goes on from them."""

    def __init__(self, root: str, dataset_id: str, config: dict):
        self.folder = os.path.join(root, ".work", dataset_id, digest(config))

    def get(self, spark: SparkSession, name: str, source: str | None = None) -> tuple[DataFrame, dict] | None:
        """The table and its sidecar; another ``source`` than that it was made from is an error."""
        side = os.path.join(self.folder, f"{name}.json")
        if not os.path.exists(side):
            return None
        with open(side, encoding="utf-8") as f:
            found = json.load(f)
        if source is not None and found.get("source") != source:
            raise ValueError("the source changed since the stage was kept")
        return spark.read.parquet(os.path.join(self.folder, name)), found

    def put(self, df: DataFrame, name: str, side: dict) -> tuple[DataFrame, dict]:
        df.write.mode("overwrite").parquet(os.path.join(self.folder, name))
        write_json_atomic(os.path.join(self.folder, f"{name}.json"), side)
        return df.sparkSession.read.parquet(os.path.join(self.folder, name)), side

    def clear(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)
