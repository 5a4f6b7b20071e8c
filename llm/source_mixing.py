"""Samples of documents whose tokens follow target shares, by iterative proportional fitting.

Tokens are summed over cells (source, language, topic).  Raking scales the cells until their sums
over each dimension meet that dimension's targets; the scale of a cell over the largest scale of a cell
with tokens is the probability of its documents, so that expected tokens have the target shares and no
document is taken twice.  DataFrame operations only; documents are read for the sums and for the sample, all
steps between work on the cells.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from llm.common import SPACE_CLASS, saved

DIMENSIONS = ("source", "lang", "topic")
#: Targets are shares to this power, scaled to one: large groups give way a little.
TEMPER = 0.95
#: Rounds of raking; each visits every dimension once.  Ends sooner when no sum is off by more than TOLERANCE.
ROUNDS, TOLERANCE = 40, 1e-12
#: Cells that are sent to every executor at most; beyond, documents are joined by their cell.
BROADCAST_CELLS = 200_000


def n_words(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE_CLASS.replace("[", "[^") + "+")).cast("long")


def layout_topic(text: str) -> Column:
    """A topic told from layout: table (a bar in twenty characters), list (a line in forty) or prose."""
    text = F.coalesce(F.col(text), F.lit(""))
    size = F.length(text)
    return F.when((size - F.length(F.replace(text, F.lit("|"), F.lit("")))) * 20 >= F.greatest(size, F.lit(1)), "table").when(
        (size - F.length(F.replace(text, F.lit("\n"), F.lit("")))) * 40 >= F.greatest(size, F.lit(1)), "list").otherwise("prose")


def uniform(column: str, seed: str) -> Column:
    """A number in [0, 1) from an id, the same on every run."""
    digits = F.substring(F.md5(F.concat(F.lit(seed), F.col(column).cast("string")).cast("binary")), 1, 12)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**12))


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """(value, target): the dimension's shares of tokens to a power, scaled to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    sums = sums.withColumn("raised", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    total = sums.agg(F.sum("raised")).first()[0]
    return sums.select("value", (F.col("raised") / F.lit(total or None)).alias("target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with a column ``scale``: tokens * scale has the target sums over each dimension.

    A target is (value, target) with shares of one.  Values without a target, or without tokens, are not scaled.
    Where the targets are still missed after all rounds, as they are when they contradict each other, a
    warning says by how much.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).first()["total"]
    columns, worst = cells.columns, 0.0
    for dimension, target in targets.items():
        goal = target.select(F.col("value").alias(dimension), (F.col("target") * F.lit(float(total))).alias(f"goal_{dimension}"))
        cells = cells.join(goal, dimension, "left")
    cells = saved(cells.withColumn("scale", F.lit(1.0)), "mixing-cells")
    for _ in range(rounds):
        scaled, off = cells, F.lit(0.0)
        for dimension in targets:
            sums = scaled.groupBy(dimension).agg(F.sum(F.col("tokens") * F.col("scale")).alias("now"))
            step = F.coalesce(F.when(F.col("now") > 0, F.col(f"goal_{dimension}") / F.col("now")), F.lit(1.0))
            scaled = scaled.join(sums, dimension, "left").withColumn(f"step_{dimension}", step).drop("now").withColumn(
                "scale", F.col("scale") * F.col(f"step_{dimension}"))
            off = F.greatest(off, F.abs(F.col(f"step_{dimension}") - 1))
        seen = Observation()
        scaled = scaled.observe(seen, F.max(off).alias("worst")).drop(*(f"step_{d}" for d in targets))
        cells = saved(scaled, "mixing-cells")
        worst = seen.get["worst"]
        if worst is None or worst <= tolerance:
            worst = 0.0
            break
    if worst > 1e-6:
        warnings.warn(f"sums miss their targets by a factor of up to {1 + worst:.6g} after {rounds} rounds", stacklevel=2)
    return cells.select(*columns, "scale")


def mix(docs: DataFrame, topic: Column | None = None, targets: dict[str, DataFrame] | None = None, doc: str = "doc_id",
        text: str = "text", source: str = "source", lang: str = "lang", seed: str = "mix",
        names: tuple[str, str, str] = ("n_tokens", "probability", "kept")) -> DataFrame:
    """All columns of ``docs`` with its number of words, probability and choice, called ``names``.

    ``topic`` defaults to the layout of the text and ``targets`` to tempered shares.  A null source, language or
    topic is a group of its own; documents without words carry no weight and have their cell's
    probability, at most one; equal ids are kept or left together, a missing id counts as the empty text.  Columns of the new names are replaced.
    """
    docs, (tokens, probability, kept) = docs.drop(*names), names
    keys = dict(zip(DIMENSIONS, (F.col(source), F.col(lang), layout_topic(text) if topic is None else topic)))
    marked = docs.withColumns({f"_{d}": F.coalesce(c.cast("string"), F.lit("(none)")) for d, c in keys.items()} |
                              {tokens: n_words(text)})
    cells = saved(marked.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS)).agg(F.sum(tokens).alias("tokens")),
                  "mixing-sums")
    if targets is None:
        targets = {d: saved(tempered(cells, d), "mixing-targets") for d in DIMENSIONS}
    scaled = rake(cells, targets)
    top = scaled.agg(F.max(F.when(F.col("tokens") > 0, F.col("scale")))).first()[0]
    chances = scaled.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS),
                             F.least(F.col("scale") / F.lit(top or 1.0), F.lit(1.0)).alias(probability))
    few = chances.count() <= BROADCAST_CELLS
    joined = marked.join(F.broadcast(chances) if few else chances, [f"_{d}" for d in DIMENSIONS])
    joined = joined.withColumn(kept, uniform_or_empty(doc, seed) < F.col(probability))
    return joined.select(*docs.columns, *names)


def uniform_or_empty(doc: str, seed: str) -> Column:
    return F.coalesce(uniform(doc, seed), F.conv(F.substring(F.md5(F.lit(seed).cast("binary")), 1, 12), 16, 10).cast("long")
                      / F.lit(float(16**12)))


def op3_source_mixing(spark, folder: str) -> DataFrame:
    """Probability and choice of every document under tempered shares of source, language and layout."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang")
    return mix(docs).select("doc_id", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def oracle(rounds: int = 14) -> str:
    """The same in DuckDB, with a fixed number of rounds."""
    blank = r"[^\x20\x09-\x0D]+"
    steps, last = [], "c0"
    for k in range(rounds * len(DIMENSIONS)):
        d = DIMENSIONS[k % len(DIMENSIONS)]
        steps.append(f"""c{k + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens,
            c.scale * coalesce(t.target * (SELECT sum(tokens) FROM c0) / nullif(s.now, 0), 1) AS scale
            FROM {last} c JOIN (SELECT {d} AS value, sum(tokens * scale) AS now FROM {last} GROUP BY ALL) s ON c.{d} = s.value
            JOIN target_{d} t ON t.value = s.value)""")
        last = f"c{k + 1}"
    targets = ", ".join(f"""target_{d} AS MATERIALIZED (SELECT value, raised / nullif(sum(raised) OVER (), 0) AS target FROM (
        SELECT {d} AS value, pow(sum(tokens)::DOUBLE, {TEMPER}) AS raised FROM c0 GROUP BY ALL))""" for d in DIMENSIONS)
    return f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
        CASE WHEN (length(t) - length(replace(t, '|', ''))) * 20 >= greatest(length(t), 1) THEN 'table'
             WHEN (length(t) - length(replace(t, chr(10), ''))) * 40 >= greatest(length(t), 1) THEN 'list' ELSE 'prose' END AS topic,
        len(regexp_extract_all(t, '{blank}'))::BIGINT AS n_tokens FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
      c0 AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens, 1.0::DOUBLE AS scale FROM d GROUP BY ALL),
      {targets}, {", ".join(steps)}
      SELECT doc_id, n_tokens, round(chance, 6) AS probability,
        ('0x' || substr(md5('mix' || doc_id), 1, 12))::BIGINT / {float(16**12)} < chance AS kept
      FROM (SELECT d.doc_id, d.n_tokens, least(1, scale / (SELECT max(scale) FROM {last} WHERE tokens > 0)) AS chance
            FROM d JOIN {last} c USING (source, lang, topic))"""
