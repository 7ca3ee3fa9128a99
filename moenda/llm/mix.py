"""Mixing sources to target weights.

Documents fall into cells of source, language and topic.  Iterative proportional
fitting rakes the tokens of the cells to the marginals of the mix: those of the
sources, of languages and of topics.  Where no goals are given for languages and topics, these are the shares that
they have in the sources of the mix, so that new weights of the sources change them as
little as may be; the sources' own goals come last and are met.
A cell's rate is how often its documents are used on average; its whole part is
used of every document, and the rest is a probability.  Documents are sampled with
these probabilities in the order of a hash divided by the probability (sequential
Poisson sampling) until the tokens of their source are reached; at the border a document that is
too long for what is left is passed over for shorter ones after it, so that no
source exceeds its goal and few miss more than a short document of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import written

CELL = ["source", "language", "topic"]
#: Rates are broadcast up to this number of rows (cells times mixes, not documents).
BROADCAST_RATES = 100_000
#: Documents from the border on among which those are looked for that fill a source's goal.
BORDER_DOCUMENTS = 10_000
#: Parts of each octave of the sampling order whose tokens are added up before the cut is looked for.
OCTAVE_PARTS = 1 << 12


def place_of(at: Column) -> Column:
    """Part of the sampling order that a positive number falls in.

    Parts are even within each octave, so whatever the probability that divides the hash,
    no part holds more than 1 / OCTAVE_PARTS of the documents that have it.
    """
    octave = F.floor(F.log2(at))
    return F.floor((octave + at / F.pow(F.lit(2.0), octave) - 1) * OCTAVE_PARTS).cast("int")


def fill(goal: float, weights: np.ndarray, caps: np.ndarray) -> np.ndarray:
    """Shares of ``goal`` in proportion to the weights, none above its cap; what capped ones
    can't take goes to the others in proportion.  Less than ``goal`` if all are capped."""
    out, open_ = np.zeros(len(weights)), (weights > 0) & (caps > 0)
    left = goal
    while open_.any() and left > 0:
        level = left / weights[open_].sum()
        full = open_ & (weights * level >= caps)
        if not full.any():
            out[open_] = weights[open_] * level
            break
        out[full] = caps[full]
        left -= caps[full].sum()
        open_ &= ~full
    return out


def rake(tokens: np.ndarray, caps: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Capped iterative proportional fitting of the cells to the margins.

    A margin is the group of each cell and the goal of each group.  The last one is
    met as far as caps allow; the others approach theirs as far as they agree.
    """
    x = tokens.astype(float)
    for _ in range(rounds):
        before = x.copy()
        for k, (group, goals) in enumerate(margins):
            if k + 1 < len(margins):
                sums = np.bincount(group, x, len(goals))
                factor = np.divide(goals, sums, out=np.ones(len(goals)), where=sums > 0)
                x = np.minimum(x * factor[group], caps)
            else:
                fitted = np.zeros(len(x))
                for g in range(len(goals)):
                    own = group == g
                    fitted[own] = fill(goals[g], x[own], caps[own])
                x = fitted
        if np.abs(x - before).max(initial=0) <= tolerance * max(1.0, x.max(initial=0)):
            break
    return x


def filled(left: float, tokens: np.ndarray) -> np.ndarray:
    """Which documents, in order, are taken when each is that still fits into what is left."""
    taken = np.zeros(len(tokens), bool)
    for k, n in enumerate(tokens.tolist()):
        if n <= left:
            taken[k] = True
            left -= n
    return taken


def _rates(cells: DataFrame, targets: DataFrame, shares: dict[str, dict[str, float]] | None) -> DataFrame:
    """(mix_id, source, language, topic, whole, part, goal, target_share) of each cell of each mix;
    a source of a mix without text has one row with null language and topic."""

    def plan(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sources = sorted({r["source"] for r in rows})
        at = {s: i for i, s in enumerate(sources)}
        weight, limit, have = np.zeros(len(sources)), np.zeros(len(sources)), np.zeros(len(sources))
        for r in rows:
            i = at[r["source"]]
            weight[i], limit[i] = max(r["weight"] or 0.0, 0.0), math.inf if r["repeats"] is None else max(r["repeats"], 0)
            have[i] += r["tokens"] or 0
        size = (rows[0]["size_ratio"] or 0.0) * (rows[0]["all_tokens"] or 0)
        caps = np.where(have > 0, np.where(np.isinf(limit), math.inf, have * np.where(np.isinf(limit), 1, limit)), 0)
        goal = fill(size, weight, caps)
        cells = [r for r in rows if r["tokens"]]
        tokens = np.array([r["tokens"] for r in cells], float)
        group = np.array([at[r["source"]] for r in cells], int)
        cell_caps = tokens * limit[group] if len(cells) else tokens
        margins = []
        own = shares
        if own is None:
            own = {name: {} for name in CELL[1:]}
            for r in cells:
                for name, sums in own.items():
                    sums[r[name]] = sums.get(r[name], 0) + r["tokens"]
        for name, wanted in own.items():
            names = sorted({r[name] for r in cells})
            of = {v: i for i, v in enumerate(names)}
            whole = sum(max(wanted.get(v, 0.0), 0.0) for v in names)
            if whole > 0:
                margins.append((np.array([of[r[name]] for r in cells], int), np.array([wanted.get(v, 0.0) for v in names]) / whole * goal.sum()))
        margins.append((group, goal))
        start = tokens * (np.divide(goal, have, out=np.zeros(len(have)), where=have > 0)[group] if len(cells) else 1)
        x = rake(start, cell_caps, margins) if len(cells) else start
        total = weight.sum() or 1.0
        out = []
        for r, fitted in zip(cells, x):
            rate = fitted / r["tokens"]
            whole = math.floor(rate + 1e-12)
            i = at[r["source"]]
            out.append((r["mix_id"], r["source"], r["language"], r["topic"], whole, max(rate - whole, 0.0), float(goal[i]), float(weight[i] / total)))
        for s in sources:
            if not have[at[s]]:
                out.append((rows[0]["mix_id"], s, None, None, 0, 0.0, 0.0, float(weight[at[s]] / total)))
        columns = list(zip(*out))
        kinds = [pa.string()] * 4 + [pa.int64()] + [pa.float64()] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["mix_id", *CELL, "whole", "part", "goal", "target_share"])

    joined = targets.join(cells, "source", "left")
    return joined.groupBy("mix_id").applyInArrow(plan, "mix_id string, source string, language string, topic string, whole bigint, part double, goal double, target_share double")


def targets_of(mix_target: DataFrame) -> DataFrame:
    """One row per mix and source: weights of repeated rows add up, and a null among
    their caps lifts the cap.  Rows without mix or source are of no mix."""
    named = mix_target.filter("mix_id is not null and source is not null")
    per_source = named.groupBy("mix_id", "source").agg(F.sum("target_weight").alias("weight"), F.when(F.count_if(F.col("max_repeats").isNull()) == 0, F.max("max_repeats")).alias("repeats"))
    sizes = named.groupBy("mix_id").agg(F.max("size_ratio").alias("size_ratio"))
    return per_source.join(sizes, "mix_id")


class Mixes:
    """Uses of the documents (doc_id, source, language, topic, tokens) in each mix.

    Documents without tokens or source are in no mix.  Languages and topics must not
    be null.  ``shares`` may give goals for ``language`` or ``topic``, by default their shares in
    the sources of the mix.
    """

    def __init__(self, sized: DataFrame, mix_target: DataFrame, shares: dict[str, dict[str, float]] | None = None):
        self.sized = written(sized.select("doc_id", *CELL, "tokens").filter("tokens > 0"), "mix-sizes")
        cells = self.sized.filter("source is not null").groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
        everything = self.sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
        targets = targets_of(mix_target).crossJoin(F.broadcast(everything))  # one row
        self.rates = written(_rates(cells, targets, shares), "mix-rates")

    def _used(self) -> DataFrame:
        """(mix_id, doc_id, source, language, topic, tokens, uses)."""
        rates = self.rates.filter("language is not null and (whole > 0 or part > 0)")
        side = F.broadcast(rates) if rates.count() <= BROADCAST_RATES else rates
        rows = self.sized.join(side, CELL)
        unit = (F.shiftrightunsigned(F.xxhash64("mix_id", "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        rows = rows.select("mix_id", "doc_id", *CELL, "tokens", "whole", "part", F.when(F.col("part") > 0, unit / F.col("part")).alias("at"))
        rows = rows.withColumn("place", place_of(F.col("at")))
        extra = rates.join(self.sized.groupBy(*CELL).agg(F.sum("tokens").alias("cell_tokens")), CELL).groupBy("mix_id", "source").agg(F.sum(F.col("part") * F.col("cell_tokens")).alias("wanted"))
        mass = rows.filter("place is not null").groupBy("mix_id", "source", "place").agg(F.sum("tokens").alias("mass"), F.count(F.lit(1)).alias("n"))
        order = W.partitionBy("mix_id", "source").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
        mass = mass.withColumns({"before": F.coalesce(F.sum("mass").over(order), F.lit(0)), "earlier": F.coalesce(F.sum("n").over(order), F.lit(0))})
        behind = mass.join(extra, ["mix_id", "source"]).filter(F.col("before") + F.col("mass") > F.col("wanted"))
        cut = behind.groupBy("mix_id", "source").agg(F.min("place").alias("cut"), F.min_by("before", "place").alias("before"), F.min_by("earlier", "place").alias("earlier"), F.first("wanted").alias("wanted"))
        last = behind.select("mix_id", "source", "place", F.col("earlier").alias("_n")).join(cut.select("mix_id", "source", "earlier"), ["mix_id", "source"]).filter(F.col("_n") - F.col("earlier") < BORDER_DOCUMENTS)
        cut = written(cut.join(last.groupBy("mix_id", "source").agg(F.max("place").alias("last")), ["mix_id", "source"]).drop("earlier"), "mix-cuts")
        # a row per mix and source, of which there are no more than rates
        rows = rows.join(F.broadcast(cut) if cut.count() <= BROADCAST_RATES else cut, ["mix_id", "source"], "left")
        # sources whose extra documents don't exceed what is wanted have no cut: all are taken
        inner = F.when(F.col("place").isNull(), 0).when(F.col("cut").isNull() | (F.col("place") < F.col("cut")), 1).when(F.col("place") > F.col("last"), 0)

        def fit(table: pa.Table) -> pa.Table:
            table = table.sort_by([("at", "ascending"), ("doc_id", "ascending")])
            left = table["wanted"][0].as_py() - table["before"][0].as_py() if table.num_rows else 0.0
            return table.select(kept).append_column("one", pa.array(filled(left, table["tokens"].to_numpy()).astype(np.int32)))

        kept = ["mix_id", "doc_id", *CELL, "tokens", "whole"]
        rows = rows.withColumn("one", inner)
        border = rows.filter("one is null").select(*kept, "at", "before", "wanted")
        kinds = dict(rows.dtypes)
        border = border.groupBy("mix_id", "source").applyInArrow(fit, ", ".join(f"{c} {kinds[c]}" for c in kept) + ", one int")
        both = rows.filter("one is not null").select(*kept, "one").unionByName(border).withColumn("uses", F.col("whole") + F.col("one"))
        return both.filter("uses > 0").select("mix_id", "doc_id", *CELL, "tokens", "uses")

    def uses(self) -> DataFrame:
        """(mix_id, doc_id, source, tokens, uses) of every document used in a mix."""
        return self._used().select("mix_id", "doc_id", "source", "tokens", "uses")

    def fits(self) -> DataFrame:
        """(mix_id, margin, name, goal_share, actual_share) of sources, and of languages and topics, whose goals
        are the shares that they have in the sources of the mix."""
        cells = self.sized.filter("source is not null").groupBy(*CELL).agg(F.sum("tokens").alias("tokens"))
        given = self.rates.filter("language is not null").select("mix_id", *CELL, "target_share").join(cells, CELL)
        used = written(self._used().groupBy("mix_id", *CELL).agg(F.sum(F.col("uses") * F.col("tokens")).alias("used")), "mix-used")
        both = given.join(used, ["mix_id", *CELL], "left").na.fill(0, ["used"])
        within = W.partitionBy("mix_id")
        rows = None
        for name in CELL:
            sums = both.groupBy("mix_id", F.lit(name).alias("margin"), F.col(name).alias("name")).agg(F.sum("tokens").alias("tokens"), F.sum("used").alias("used"), F.max("target_share").alias("target_share"))
            goal = F.col("target_share") if name == "source" else F.col("tokens") / F.sum("tokens").over(within)
            part = sums.select("mix_id", "margin", "name", goal.alias("goal_share"), F.coalesce(F.col("used") / F.nullif(F.sum("used").over(within), F.lit(0)), F.lit(0.0)).alias("actual_share"))
            rows = part if rows is None else rows.unionByName(part)
        return rows

    def shares(self) -> DataFrame:
        """(mix_id, source, target_share, documents, uses, tokens, actual_share); sources without
        text are listed with zeros."""
        wanted = self.rates.groupBy("mix_id", "source").agg(F.first("target_share").alias("target_share"))
        used = self.uses().groupBy("mix_id", "source").agg(F.count(F.lit(1)).alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
        rows = wanted.join(used, ["mix_id", "source"], "left").na.fill(0, ["documents", "uses", "tokens"])
        return rows.withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(F.sum("tokens").over(W.partitionBy("mix_id")), F.lit(0)), F.lit(0.0)))
