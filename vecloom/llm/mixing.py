"""Mixing to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are summed by cell (source, language, topic).  A cell's share of the wanted sample is its
tokens times one factor a marginal, but never more than its own tokens; each step of a raking sweep sets
the factors of one marginal so that these bounded shares sum to its targets exactly.  Sweeps go on until
one finds every marginal within ``TOLERANCE`` (relative).  Because the bound is part of the fit, the
sampling probability of a cell, its share over its tokens, is at most 1 and the expected tokens of the
*sample* meet the targets.  A document stays if a hash of its id, read as a number in [0, 1), is below
its cell's probability.

Targets: given shares, or flattened natural ones (``FLATTEN``).  No value can give more than it has: a
target beyond ``RESERVE`` of its tokens is cut to that, the others of the marginal take the rest in
proportion, and a warning says so if the target was given.  Targets that still contradict each other
(no sample meets them) end the sweeps where these change nothing more, or after ``MOST_SWEEPS``, with a
warning that gives the error left.

Scale: the documents are read once for the cells, pre-aggregated before the shuffle (a source with a
third of all rows moves no more than any other), and once for sampling.  A sweep is three window passes
over the cell table, one a marginal; ``SWEEPS_A_JOB`` sweeps are one plan whose result is written.  The
cell table is broadcast only where the optimizer finds its written size small; a larger one is joined
with skew handling.  Only single numbers reach the driver.  No Python touches rows.

Defined results: null source, language or topic is a value of its own; a null text is an empty one; a
cell without tokens has probability 0 (1 if nothing has tokens); targets of values that do not occur
are dropped and the rest rescaled; values without a target share what the targets leave of 1 in
proportion to their tokens; repeated rows share their fate; a null id hashes like the word null; an
empty table gives an empty result; every input column is kept, clashing names included.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.tables import free_name, quoted
from vecloom.plans.durable import ROWS_PER_FILE, materialize, materialized

DIMS = ("source", "lang", "topic")
TOLERANCE = 1e-9
SWEEPS_A_JOB = 5
MOST_SWEEPS = 600
RESERVE = 0.9
BUDGET = 0.5
SEED = 29
#: Exponents that flatten the natural token shares where no targets are given.
FLATTEN = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: A token: a run of letters, marks, digits and underscores, or a run of other visible characters.
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\x00-\x20]+"


def token_count(text: Column) -> Column:
    """Words and runs of punctuation of a text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def topic_of(text: Column) -> Column:
    """The form a text has, standing in for a topic column: table, shout, marked, short or prose."""
    text = F.coalesce(text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shout")
        .when(F.contains(text, F.lit("###")) | F.contains(text, F.lit("$$$")), "marked")
        .when(F.octet_length(text) < 600, "short")
        .otherwise("prose")
    )


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def reserve_of(budget: float) -> float:
    """The largest share of its tokens that a target may ask of a value; 1 where all is wanted."""
    return max(RESERVE, (1 + budget) / 2)


def _filled(table: DataFrame, whole: float, most_steps: int = 200) -> float:
    """The factor with which least(factor * raw, most) sums to ``whole``: the cut values fixed, what is
    left spread over the others, until none more is cut."""
    factor = 0.0
    for _ in range(most_steps):
        cut = F.col("raw") * F.lit(factor) >= F.col("most")
        part = table.agg(F.coalesce(F.sum(F.when(cut, F.col("most"))), F.lit(0.0)).alias("fixed"), F.coalesce(F.sum(F.when(~cut, F.col("raw"))), F.lit(0.0)).alias("open")).first()
        following = (whole - part["fixed"]) / part["open"] if part["open"] > 0 else factor
        if following <= factor * (1 + 1e-12):
            break
        factor = following
    return factor


def marginal_targets(cells: DataFrame, dim: str, wanted: dict | None, power: float, budget: float, total: int) -> DataFrame:
    """(dim, target) for the values that have tokens; targets sum to 1, none beyond what a value can give."""
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    most = (F.col("t") * F.lit(reserve_of(budget) / (budget * total))).alias("most")
    if wanted is None:
        raw = own.select(dim, most, F.pow("t", F.lit(power)).alias("raw"))
    else:
        schema = T.StructType([T.StructField("value", T.StringType()), T.StructField("share", T.DoubleType())])
        given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in wanted.items()], schema)
        own = own.join(given, F.col(dim).cast("string").eqNullSafe(F.col("value")), "left").drop("value")
        free = own.agg(F.sum(F.when(F.col("share").isNull(), F.col("t"))).alias("free")).first()["free"] or 1.0
        rest = max(0.0, 1.0 - sum(wanted.values()))
        raw = own.select(dim, most, F.coalesce("share", F.lit(rest / free) * F.col("t")).alias("raw"))
    raw = materialize(raw, "shares")
    whole = raw.agg(F.sum("raw").alias("whole")).first()["whole"] or 1.0
    factor = _filled(raw, 1.0)
    if wanted is not None and factor * whole > 1 + 1e-9:
        warnings.warn(f"targets of {dim} ask for more tokens than some values have; these are cut to {reserve_of(budget):.0%} of their tokens", stacklevel=3)
    return raw.select(dim, F.least(F.col("raw") * F.lit(factor), F.col("most")).alias("target"))


def step_sql(rows: str, dim: str, dims) -> str:
    """Cells after one marginal is set: ``u`` (unbounded share) times the factor f with which
    least(f * u, most) sums to the target, found among the factors that assume the first k cells by
    most / u to be at their bound; ``error`` is the larger of what was and what this marginal was off."""
    kept = ", ".join([*dims, "tokens", "cell", "most", *[f"t_{d}" for d in dims]])
    value = f"PARTITION BY {dim}"
    bend = f"SELECT *, CASE WHEN u > 0 THEN most / u ELSE CAST('Infinity' AS DOUBLE) END AS bend FROM ({rows}) AS r"
    bound = f"coalesce(sum(most) OVER ({value} ORDER BY bend, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    left = f"nullif(sum(u) OVER ({value} ORDER BY bend DESC, cell DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    trial = f"SELECT *, greatest(t_{dim} - {bound}, 0) / {left} AS trial FROM ({bend}) AS b"
    fits, most = "CASE WHEN u > 0 AND trial <= bend THEN trial END", "CASE WHEN u > 0 THEN bend END"
    found = f"SELECT *, coalesce(max({fits}) OVER ({value}), max({most}) OVER ({value}), 0) AS f, sum(least(u, most)) OVER ({value}) AS held FROM ({trial}) AS t"
    off = f"CASE WHEN t_{dim} > 0 THEN abs(held / t_{dim} - 1) ELSE held END"
    return f"SELECT {kept}, CASE WHEN u > 0 THEN u * f ELSE 0 END AS u, greatest(error, {off}) AS error FROM ({found}) AS f"


def sweep_sql(rows: str, dims) -> str:
    """One raking sweep over all marginals; ``error`` starts anew."""
    kept = ", ".join([*dims, "tokens", "cell", "most", *[f"t_{d}" for d in dims], "u"])
    rows = f"SELECT {kept}, CAST(0 AS DOUBLE) AS error FROM {rows}"
    for dim in dims:
        rows = step_sql(rows, dim, dims)
    return rows


def rake(cells: DataFrame, dims, sweeps: int = MOST_SWEEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, float]:
    """(cells with the fitted ``u``, largest relative error of a marginal); a warning gives the error where
    ``sweeps`` sweeps do not bring it below ``tolerance``."""
    now, errors, done = materialized(cells, "rake"), [], 0
    files = 1 + now.df.count() // ROWS_PER_FILE  # in one partition windows need no exchange
    while done < sweeps:
        following = now.df.coalesce(files)
        for _ in range(min(SWEEPS_A_JOB, sweeps - done)):
            following = cells.sparkSession.sql(sweep_sql("{cells}", dims), cells=following)
            done += 1
        after = materialized(following, "rake")
        now.drop()
        now = after
        errors.append(now.df.agg(F.max("error").alias("error")).first()["error"] or 0.0)  # found by the last sweep before it set each marginal
        stuck = len(errors) > 10 and abs(errors[-1] - errors[-11]) <= 1e-9 * errors[-1]
        if errors[-1] <= tolerance or stuck:
            break
    error = errors[-1] if errors else 0.0
    if error > max(tolerance, 1e-6):
        warnings.warn(f"marginals contradict each other: they miss their targets by up to {error:.3g} (relative) after {done} sweeps", stacklevel=2)
    return now.df, error


def fitted_cells(found: DataFrame, dims, targets: dict[str, dict] | None, budget: float, sweeps: int) -> DataFrame:
    """dims, tokens, weight (share of the sample) and probability of every cell."""
    found = materialize(found, "cells")
    total = found.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return found.withColumn("weight", F.lit(0.0)).withColumn("probability", F.lit(1.0))
    full = found.where("tokens > 0")
    cells = full.withColumns({"cell": F.xxhash64(*dims), "u": F.col("tokens") / F.lit(float(total)), "most": F.col("tokens") / F.lit(budget * total), "error": F.lit(0.0)})
    for dim in dims:
        wanted = marginal_targets(full, dim, (targets or {}).get(dim), FLATTEN.get(dim, 1.0), budget, total)
        own = wanted.select(F.col(dim).alias("v"), F.col("target").alias(f"t_{dim}"))
        cells = cells.join(own, cells[dim].eqNullSafe(own["v"])).drop("v")
    raked, _ = rake(cells, dims, sweeps)
    fitted = raked.select(*dims, "tokens", F.least("u", "most").alias("weight"), F.least(F.lit(1.0), F.col("u") / F.col("most")).alias("probability"))
    return fitted.unionByName(found.where("tokens = 0").withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0)}))


def mixed(
    docs: DataFrame,
    dims: dict[str, Column],
    tokens: Column,
    id_col: str = "doc_id",
    targets: dict[str, dict] | None = None,
    budget: float = BUDGET,
    sweeps: int = MOST_SWEEPS,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame, dict[str, str]]:
    """(docs with cell columns and probability, the cell table, the added columns' names).

    ``dims`` maps a marginal's name to its value; ``targets`` maps marginals to {value: share}.
    """
    names = {x: free_name(docs, x) for x in (*dims, "tokens", "probability", "kept")}
    rows = docs.withColumns({names[d]: value for d, value in dims.items()} | {names["tokens"]: tokens})
    found = rows.groupBy(*[F.col(names[d]).alias(d) for d in dims]).agg(F.sum(names["tokens"]).alias("tokens"))
    fitted = materialize(fitted_cells(found, list(dims), targets, budget, sweeps), "fitted")
    chance = fitted.select(*[F.col(d).alias(f"cell_{d}") for d in dims], F.col("probability").alias(names["probability"]))
    same = [rows[names[d]].eqNullSafe(chance[f"cell_{d}"]) for d in dims]
    condition = same[0]
    for more in same[1:]:
        condition = condition & more
    placed = rows.join(chance, condition).drop(*[f"cell_{d}" for d in dims])
    kept = unit_hash(F.col(quoted(id_col)), seed) < F.col(names["probability"])
    return placed.withColumn(names["kept"], kept), fitted, names


def document_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col("text"))}


def document_mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every document."""
    slim = docs.select("doc_id", *[c.alias(d) for d, c in document_dims().items()], token_count(F.col("text")).alias("n_tokens"))
    placed, _, names = mixed(slim, {d: F.col(d) for d in DIMS}, F.col("n_tokens"))
    return placed.select("doc_id", *DIMS, "n_tokens", F.round(names["probability"], 6).alias("probability"), F.col(names["kept"]).alias("kept"))


def keep_sampled(docs: DataFrame) -> DataFrame:
    """The documents the mixture keeps, with their own columns."""
    placed, _, names = mixed(docs, document_dims(), token_count(F.col("text")))
    return placed.where(F.col(names["kept"])).select(*[F.col(quoted(c)) for c in docs.columns])


def mixture_sql(sweeps: int = 120, budget: float = BUDGET, seed: int = SEED) -> str:
    """The same rows in DuckDB SQL over ``documents``: targets filled and marginals set by window sums,
    the sweeps as a recursion."""

    def filled(shares: str) -> str:
        """least(factor * raw, most) summing to 1."""
        return f"""SELECT *, coalesce(max(trial) FILTER (trial <= bend) OVER (), max(bend) OVER ()) AS f FROM (SELECT *, most / raw AS bend,
            (1 - coalesce(sum(most) OVER (ORDER BY most / raw, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(raw) OVER (ORDER BY most / raw DESC, value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS trial FROM {shares})"""

    ctes = [
        f"""p AS MATERIALIZED (SELECT doc_id, source, lang, len(regexp_extract_all(x, '{TOKEN}')) AS n_tokens, CASE WHEN contains(x, ' | ') THEN 'table' WHEN contains(x, '!!') THEN 'shout'
            WHEN contains(x, '###') OR contains(x, '$$$') THEN 'marked' WHEN strlen(x) < 600 THEN 'short' ELSE 'prose' END AS topic FROM (SELECT doc_id, source, lang, coalesce(text, '') AS x FROM documents))""",
        "found AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens, sum(sum(n_tokens)) OVER ()::DOUBLE AS total, row_number() OVER () AS cell FROM p GROUP BY source, lang, topic)",
    ]
    for dim in DIMS:
        shares = f"(SELECT {dim}, row_number() OVER () AS value, pow(sum(tokens), {FLATTEN[dim]}) AS raw, sum(tokens) * {reserve_of(budget)} / ({budget} * any_value(total)) AS most FROM found WHERE tokens > 0 GROUP BY {dim})"
        ctes.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, least(raw * f, most) AS target FROM ({filled(shares)}))")
    joins = " ".join(f"JOIN t_{d} ON t_{d}.{d} IS NOT DISTINCT FROM c.{d}" for d in DIMS)
    goals = ", ".join(f"t_{d}" for d in DIMS)
    start = f"SELECT 0 AS k, c.source, c.lang, c.topic, tokens, cell, tokens / ({budget} * total) AS most, {', '.join(f't_{d}.target AS t_{d}' for d in DIMS)}, tokens / total AS u FROM found c {joins} WHERE tokens > 0"
    sweep = sweep_sql(f"raked WHERE k < {sweeps}", DIMS)
    kept = f"source, lang, topic, tokens, cell, most, {goals}, u"
    ctes.append(f"raked AS ({start} UNION ALL SELECT (SELECT max(k) + 1 FROM raked), {kept} FROM ({sweep}))")
    return f"""WITH RECURSIVE {", ".join(ctes)}
        SELECT doc_id, p.source, p.lang, p.topic, n_tokens, round(pr, 6) AS probability,
            ('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / {float(1 << 52)} < pr AS kept
        FROM p JOIN (SELECT f.source, f.lang, f.topic, CASE WHEN total = 0 THEN 1.0 WHEN tokens = 0 THEN 0.0 ELSE least(1.0, u / most) END AS pr
            FROM found f LEFT JOIN (SELECT cell, u, most FROM raked WHERE k = {sweeps}) r USING (cell)) c
        ON p.source IS NOT DISTINCT FROM c.source AND p.lang IS NOT DISTINCT FROM c.lang AND p.topic IS NOT DISTINCT FROM c.topic"""
