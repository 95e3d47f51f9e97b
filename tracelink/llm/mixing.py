"""Mixing to target weights by iterative proportional fitting, in DataFrame functions only.

Tokens are summed per cell (source, language, topic). A margin's target is what is to be kept of each of its values: its
given weight, or its token share to the power ``temper``, scaled so that a margin's targets add up to ``keep`` of
all tokens and none is more than the tokens there are (what a full value cannot take goes to the others in
proportion). Raking starts from ``keep`` of each cell's tokens and meets one margin after the other, round after round: of a
value's cells those that are kept whole count with their tokens, and the others are multiplied by what is left of the
target over their sum, up to their tokens. So what is raked are the expected kept tokens themselves, and the draw has the targets'
margins: a document of cell c is kept with probability w_c / t_c, which no later step cuts. The draw is the document's own hash,
so a document's fate does not depend on the others' order. ``residuals`` tells how far the margins are from the targets,
as they stay where no probabilities meet all of them.

The topic is a column that the caller passes, or else the first rule whose string the text contains.

Every step is an aggregate or an equi join on cells: tokens are pre-aggregated map-side, margins are
small or joined by key (see ``rake`` and ``rake_few``), and the join back to the documents may be split where a cell is hot.

Edge cases: a null source, language or topic counts as ``unknown``; a null or blank text has 0 tokens, and so
does not move the weights; a cell with target 0 has probability 0; a document without tokens is kept with the mean rate
``keep``, if its cell has no tokens at all; rows with the same doc_id, or none, share a draw; an empty
table gives an empty result; extra columns are kept, and columns named like the added ones are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelink.session import shared_dir

#: (topic, string that its texts contain), first match first; texts without any are ``prose``.
TOPICS = (("licence", "icensed under"), ("table", " | "), ("contact", "@"), ("shout", "!!"))
MARGINS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: A cell with this share of its tokens is kept whole; the rest is rounding.
WHOLE = 1 - 1e-9
#: Cells up to this number are raked in one row and broadcast to the documents; more are shuffled.
SMALL = 50_000


def topic(text: Column, rules=TOPICS) -> Column:
    out = F.lit("prose")
    for name, part in reversed(rules):
        out = F.when(F.contains(text, F.lit(part)), F.lit(name)).otherwise(out)
    return out


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number from 0 to 1, the same for the same id: 52 bits of an md5."""
    key = F.concat_ws(":", F.lit(seed), doc_id.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_cells(docs: DataFrame, rules=TOPICS, topics: Column | None = None) -> DataFrame:
    """``docs`` with mix_source, mix_lang and mix_topic."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return docs.withColumns({"mix_source": known(F.col("source")), "mix_lang": known(F.col("lang")), "mix_topic": topic(F.coalesce("text", F.lit("")), rules) if topics is None else known(topics)})


def tempered(cells: DataFrame, margin: str, temper: float) -> DataFrame:
    """(margin, target): token shares to the power ``temper``, not normalised."""
    return cells.groupBy(margin).agg(F.sum("tokens").alias("n")).where("n > 0").select(margin, F.pow(F.col("n").cast("double"), F.lit(temper)).alias("target"))


def fill(margin: DataFrame, total: float, steps: int) -> float:
    """The factor f at which min(tokens, f * w) adds up to ``total``."""
    f = None
    for _ in range(steps):
        full = F.lit(False) if f is None else F.col("w") * F.lit(f) >= F.col("tokens")
        capped, rest = margin.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if not rest:
            break
        before, f = f, (total - capped) / rest
        if f == before:  # no further value is full
            break
    return f or 0.0


def reachable(cells: DataFrame, margin: str, weights: DataFrame, total: float, steps: int) -> DataFrame:
    """(margin, target): tokens to keep of each value, in proportion to ``weights`` (margin, target) where the value has as many."""
    own = cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")).join(weights.select(margin, F.col("target").alias("w")), margin).checkpoint()
    return own.select(margin, F.least(F.col("tokens").cast("double"), F.lit(fill(own, total, steps)) * F.col("w")).alias("target"))


def stepped(full: Column, open_: Column) -> Column:
    """w after a step to ``target``, when the value's whole cells sum to ``full`` and the others to ``open_``."""
    target = F.coalesce(F.col("target"), F.lit(0.0))
    factor = F.when((open_ > 0) & (target > full), (target - full) / open_).when(full + open_ > 0, target / (full + open_)).otherwise(0.0)
    return F.least(F.col("tokens").cast("double"), F.col("w") * factor)


def rake_few(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, keep: float) -> DataFrame:
    """``rake`` for few cells: these are one row of arrays, and all rounds are one expression over it. A margin's values are numbered and its cells sorted
    by value once, so a round takes time in proportion to the cells."""
    own = cells
    for m, t in targets.items():
        own = own.join(t.withColumnRenamed("target", f"{m}_target"), m, "left").withColumn(f"{m}_at", F.dense_rank().over(Window.orderBy(m)) - 1)
    row = own.agg(F.array_sort(F.collect_list(F.struct(*own.columns))).alias("c"))
    row = row.selectExpr("c", "transform(c, x -> cast(x.tokens AS double)) AS t")
    for m in targets:
        # the value of each cell by number, the cells in order of these, where each value begins, and the cells of each value
        row = row.selectExpr("*", f"transform(c, x -> x.{m}_at) AS {m}_at", f"array_sort(transform(c, (x, k) -> named_struct('n', x.{m}_at, 'k', k))) AS by")
        row = row.selectExpr("*", "filter(transform(by, (x, i) -> i), i -> i = 0 OR by[i].n <> by[i - 1].n) AS first").selectExpr("*", f"transform(first, (i, n) -> slice(by.k, i + 1, coalesce(get(first, n + 1), size(by)) - i)) AS {m}_cells").drop("by", "first")
        row = row.selectExpr("*", f"transform({m}_cells, p -> coalesce(c[p[0]].{m}_target, 0D)) AS {m}_target")

    def step(w: str, m: str) -> str:
        whole = f"{w}[k] >= t[k] * {WHOLE!r}D"
        factor = f"CASE WHEN a.o > 0 AND {m}_target[n] > a.f THEN ({m}_target[n] - a.f) / a.o WHEN a.f + a.o > 0 THEN {m}_target[n] / (a.f + a.o) ELSE 0D END"
        sums = f"aggregate(p, named_struct('f', 0D, 'o', 0D), (a, k) -> named_struct('f', a.f + if({whole}, t[k], 0D), 'o', a.o + if({whole}, 0D, {w}[k])), a -> {factor})"
        return f"transform(array(transform({m}_cells, (p, n) -> {sums})), s -> transform({w}, (x, k) -> least(t[k], x * s[{m}_at[k]])))[0]"

    body, names = "", [f"w{n}" for n in range(len(targets))]
    for w, m in reversed(list(zip(names, targets, strict=True))):  # each step's result is bound to a name before the next
        body = step(w, m) if not body else f"transform(array({step(w, m)}), {names[names.index(w) + 1]} -> {body})[0]"
    row = row.selectExpr("c", f"aggregate(sequence(1, {rounds}), transform(t, x -> x * {keep!r}D), ({names[0]}, r) -> {body}) AS w")
    fields = ", ".join(f"'{c}', x.{c}" for c in cells.columns)
    return row.selectExpr(f"inline(zip_with(c, w, (x, y) -> named_struct({fields}, 'w', y)))").checkpoint()


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int, keep: float) -> DataFrame:
    """``cells`` with w, the expected kept tokens. Margins are aggregated map-side and joined back, so that no task holds a whole margin."""
    w = cells.withColumn("w", F.col("tokens").cast("double") * F.lit(keep))
    whole = F.col("w") >= F.col("tokens") * F.lit(WHOLE)
    full, open_ = F.sum(F.when(whole, F.col("tokens").cast("double")).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(F.col("w")))
    for _ in range(rounds):
        for m, t in targets.items():
            now = w.groupBy(m).agg(full.alias("full"), open_.alias("open")).join(t, m, "left")
            # without the checkpoint each step would compute the one before twice
            w = w.join(now, m).withColumn("w", stepped(F.col("full"), F.col("open"))).select(*cells.columns, "w").checkpoint()
    return w


def probabilities(docs: DataFrame, keep: float = 0.7, temper: float = 0.7, rounds: int = 30, steps: int = 12, targets: dict[str, DataFrame] | None = None, rules=TOPICS, topics: Column | None = None) -> DataFrame:
    """(mix_source, mix_lang, mix_topic, tokens, w, p) of every cell.

    ``targets`` maps a margin's column (mix_source, mix_lang or mix_topic) to (that column, target);
    values that are not listed have target 0.
    """
    return fitted(docs, keep, temper, rounds, steps, targets, rules, topics)[0]


def fitted(docs: DataFrame, keep: float, temper: float, rounds: int, steps: int, targets, rules, topics) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``probabilities``, and the targets that they are raked to: of each margin (that column, target in tokens)."""
    shared_dir(docs.sparkSession)
    names = [f"mix_{m}" for m in MARGINS]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    cells = with_cells(docs, rules, topics).groupBy(*names).agg(F.sum(words).alias("tokens")).checkpoint()
    n, total = cells.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    total = keep * float(total or 0)
    if n <= SMALL:  # few cells lie in one partition
        cells = cells.coalesce(1).checkpoint()
    own = {m: (targets or {}).get(m) for m in names}
    goals = {m: reachable(cells, m, tempered(cells, m, temper) if t is None else t, total, steps) for m, t in own.items()}
    w = (rake_few if n <= SMALL else rake)(cells, goals, rounds, keep)
    return w.withColumn("p", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(F.lit(keep))), goals


def residuals(p: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """(margin, value, target, expected): the kept tokens that each value should have and those that it is expected to have."""
    parts = [p.groupBy(m).agg(F.sum("w").alias("expected")).join(t, m, "left").select(F.lit(m).alias("margin"), F.col(m).alias("value"), F.coalesce("target", F.lit(0.0)).alias("target"), "expected") for m, t in goals.items()]
    return reduce(DataFrame.unionByName, parts)


def mix(docs: DataFrame, keep: float = 0.7, temper: float = 0.7, rounds: int = 30, steps: int = 12, targets: dict[str, DataFrame] | None = None, rules=TOPICS, topics: Column | None = None) -> DataFrame:
    """``docs`` with topic, weight (probability over ``keep``), probability and selected."""
    names = [f"mix_{m}" for m in MARGINS]
    p = probabilities(docs, keep, temper, rounds, steps, targets, rules, topics)
    rates = p.select(*names, (F.col("p") / F.lit(keep)).alias("weight"), F.col("p").alias("probability"))
    if rates.count() <= SMALL:  # else texts would be shuffled to meet a table that fits everywhere
        rates = F.broadcast(rates)
    base = docs if topics is None else docs.withColumn("mix_topic", topics)
    base = with_cells(base, rules, None if topics is None else F.col("mix_topic")).drop("topic", "weight", "probability", "selected")
    return base.join(rates, names).withColumn("selected", draw(F.col("doc_id")) < F.col("probability")).withColumnRenamed("mix_topic", "topic").drop("mix_source", "mix_lang")


def drawn(docs: DataFrame, **options) -> DataFrame:
    """The selected rows of ``docs`` with exactly its columns; names that mixing adds may be among them."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", "source", "lang")
    return mix(packed, **options).where("selected").select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, probability and decision of every document."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "source", "lang", "topic", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "selected")


def mixing_sql(table: str = "documents", keep: float = 0.7, temper: float = 0.7, rounds: int = 30, steps: int = 12) -> str:
    """The same in DuckDB SQL: CTEs up to ``mixed`` (every document with its decision)."""
    rules = " ".join(f"WHEN contains(coalesce(text, ''), '{part}') THEN '{name}'" for name, part in TOPICS)
    names = "mix_source, mix_lang, mix_topic"
    out = [
        f"base AS (SELECT *, coalesce(source, 'unknown') AS mix_source, coalesce(lang, 'unknown') AS mix_lang, CASE {rules} ELSE 'prose' END AS mix_topic FROM {table})",
        f"c AS MATERIALIZED (SELECT {names}, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens FROM base GROUP BY ALL)",
        f"total AS (SELECT {keep} * CAST(sum(tokens) AS DOUBLE) AS t FROM c)",
    ]
    for m in MARGINS:
        out.append(f"t_{m} AS MATERIALIZED (SELECT mix_{m}, sum(tokens) AS tokens, pow(CAST(sum(tokens) AS DOUBLE), {temper}) AS w FROM c GROUP BY 1 HAVING sum(tokens) > 0)")
        out.append(f"f_{m}0 AS MATERIALIZED (SELECT (SELECT t FROM total) / sum(w) AS f FROM t_{m})")
        for k in range(1, steps):
            full = f"w * (SELECT f FROM f_{m}{k - 1}) >= tokens"
            out.append(f"f_{m}{k} AS MATERIALIZED (SELECT CASE WHEN sum(CASE WHEN {full} THEN 0 ELSE w END) > 0 THEN ((SELECT t FROM total) - sum(CASE WHEN {full} THEN tokens ELSE 0 END)) / sum(CASE WHEN {full} THEN 0 ELSE w END) ELSE (SELECT f FROM f_{m}{k - 1}) END AS f FROM t_{m})")
        out.append(f"s_{m} AS MATERIALIZED (SELECT mix_{m}, least(CAST(tokens AS DOUBLE), (SELECT f FROM f_{m}{steps - 1}) * w) AS target FROM t_{m})")
    targets = ", ".join(f"coalesce(s_{m}.target, 0) AS g_{m}" for m in MARGINS)
    joins = " ".join(f"LEFT JOIN s_{m} USING (mix_{m})" for m in MARGINS)
    out.append(f"w0 AS MATERIALIZED (SELECT {names}, tokens, CAST(tokens AS DOUBLE) * {keep} AS w, {targets} FROM c {joins})")
    at, kept = 0, ", ".join(f"g_{m}" for m in MARGINS)
    for _ in range(rounds):
        for m in MARGINS:
            factor = f"CASE WHEN o > 0 AND g_{m} > fu THEN (g_{m} - fu) / o WHEN fu + o > 0 THEN g_{m} / (fu + o) ELSE 0 END"
            out.append(f"w{at + 1} AS MATERIALIZED (SELECT {names}, tokens, least(CAST(tokens AS DOUBLE), w * {factor}) AS w, {kept} FROM (SELECT *, sum(CASE WHEN w >= tokens * CAST({WHOLE} AS DOUBLE) THEN CAST(tokens AS DOUBLE) ELSE 0 END) OVER (PARTITION BY mix_{m}) AS fu, sum(CASE WHEN w >= tokens * CAST({WHOLE} AS DOUBLE) THEN 0 ELSE w END) OVER (PARTITION BY mix_{m}) AS o FROM w{at}))")
            at += 1
    out.append(f"p AS MATERIALIZED (SELECT {names}, CASE WHEN tokens > 0 THEN w / tokens ELSE {keep} END AS probability FROM w{at})")
    out.append(f"mixed AS (SELECT base.*, probability / {keep} AS weight, probability, CAST('0x' || substr(md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR))), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS selected FROM base JOIN p USING ({names}))")
    return ", ".join(out)


OP10_SQL = f"WITH {mixing_sql()} SELECT doc_id, source, lang, mix_topic AS topic, round(weight, 6) AS weight, round(probability, 6) AS probability, selected FROM mixed"
