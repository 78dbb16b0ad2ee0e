"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Every document belongs to a cell (source, language, topic). Token totals of the cells are raked until their sums by
source, by language and by topic meet the target marginals; a cell's raked total over its own total is the weight of its
tokens. The weights are scaled so that the expected number of sampled tokens is the wanted share of the corpus, with
probabilities of at most 1 and the excess spread over the rest (water filling). A document is sampled when a hash of its
id is below its cell's probability, so that the choice is stable and needs no state.

The texts are read once; what follows works on small rows. Cells are sums with map-side combine, so a source with a third
of all rows is one row per partition. Targets default to tempered shares (share ** temper).

The topic is the column ``topic`` of documents if there is one, else a class by marker words; ``targets`` gives wanted shares by
dimension and value.

Defined cases: null text counts as empty (no tokens, topic 'general'); null source or language is 'unknown'; a cell without
tokens gets weight 1 and the mean probability; repeated rows are sampled alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import durable, text_or_empty, unit_hash, unused

#: Topics by marker words, in order of precedence.
TOPICS = {
    "legal": ["license", "copyright", "warranty", "liability"],
    "code": ["def ", "return ", "import ", "function", "{", "};"],
    "tabular": ["|", "\t"],
    "contact": ["@", "+1", "phone", "email"],
    "web": ["http", "www.", "<p", "<div"],
}
DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.5
SHARE = 0.5
ROUNDS = 8
SALT = "mix-1"


def topic_of(text: Column, topics: dict[str, list[str]] = TOPICS) -> Column:
    """The topic with the most distinct markers present; ties go to the earlier topic; none: 'general'."""
    low = F.lower(text)
    hits = [sum((low.contains(word).cast("int") for word in words), F.lit(0)) for words in topics.values()]
    most = F.greatest(*hits) if len(hits) > 1 else hits[0]
    found = F.when(most == 0, F.lit("general"))
    for name, hit in zip(topics, hits, strict=True):
        found = found.when(hit == most, F.lit(name))
    return found


def topic_column(docs: DataFrame) -> Column:
    """The topic that docs has, or the one that the markers tell."""
    return F.coalesce(docs["topic"].cast("string"), F.lit("unknown")) if "topic" in docs.columns else topic_of(text_or_empty())


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def features(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        "doc_id",
        F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"),
        topic_column(docs).alias("topic"),
        token_count(text).alias("n_tokens"),
    )


def cell_weights(rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row per cell: source, lang, topic, cell_tokens, weight, probability. targets: shares by dimension and value."""
    cells = rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("cell_tokens"))
    fitted = cells.withColumn("raked", F.col("cell_tokens").cast("double"))
    for dim in DIMENSIONS:
        own = Window.partitionBy(dim)
        if targets and dim in targets:
            wanted = F.coalesce(F.create_map(*[F.lit(x) for pair in targets[dim].items() for x in pair])[F.col(dim)], F.lit(0.0)).cast("double")
        else:
            wanted = F.pow(F.sum("cell_tokens").over(own).cast("double"), F.lit(temper))
        fitted = fitted.withColumn(f"goal_{dim}", wanted).withColumn(f"parts_{dim}", F.count(F.lit(1)).over(own))
    # every value's goal counts once, whatever the number of its cells
    fitted = durable(fitted)
    sums = fitted.agg(F.sum("cell_tokens").alias("all"), *[F.sum(F.col(f"goal_{d}") / F.col(f"parts_{d}")).alias(d) for d in DIMENSIONS]).first()
    for dim in DIMENSIONS:
        whole = F.lit(sums[dim] or None).cast("double")
        fitted = fitted.withColumn(f"goal_{dim}", F.coalesce(F.col(f"goal_{dim}") / whole * F.lit(sums["all"]).cast("double"), F.lit(0.0)))
    for _ in range(rounds):
        for dim in DIMENSIONS:
            now = F.sum("raked").over(Window.partitionBy(dim))
            fitted = fitted.withColumn("raked", F.when(now > 0, F.col("raked") * F.col(f"goal_{dim}") / now).otherwise(F.lit(0.0)))
    fitted = durable(fitted.select(*DIMENSIONS, "cell_tokens", F.when(F.col("cell_tokens") > 0, F.col("raked") / F.col("cell_tokens")).otherwise(F.lit(1.0)).alias("weight")))
    scale = _fill(fitted, share)
    probability = F.least(F.lit(1.0), F.lit(scale) * F.col("weight"))
    return fitted.select(*DIMENSIONS, "cell_tokens", F.round("weight", 9).alias("weight"), F.round(F.when(F.col("cell_tokens") > 0, probability).otherwise(F.lit(share)), 9).alias("probability"))


def _fill(cells: DataFrame, share: float) -> float:
    """The scale of the weights at which the expected tokens are the wanted share: cells that reach probability 1 are full, the rest
    shares what is left. Each round only adds full cells, so it ends; all that comes to the driver is three sums a round."""
    scale, seen = 0.0, None
    while True:
        full = F.col("weight") * scale >= 1
        sums = cells.agg(F.sum("cell_tokens").alias("all"), F.coalesce(F.sum(F.when(full, F.col("cell_tokens"))), F.lit(0)).alias("full"), F.sum(F.when(~full, F.col("cell_tokens") * F.col("weight"))).alias("rest")).first()
        if not sums["rest"] or sums["full"] == seen:
            return scale
        seen, scale = sums["full"], (sums["all"] * share - sums["full"]) / sums["rest"]


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, share: float = SHARE, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, source, lang, topic, n_tokens, weight, probability, sampled."""
    rows = durable(features(docs))
    cells = durable(cell_weights(rows, targets, temper, share, rounds).drop("cell_tokens"))  # its size is known from here on
    joined = rows.join(cells, list(DIMENSIONS), "left")
    return joined.select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", (unit_hash(F.col("doc_id"), SALT) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs with all their columns: cells are looked up by value, ids aren't joined."""
    names = {d: unused(docs, f"cell_{d}") for d in (*DIMENSIONS, "probability")}
    cells = durable(cell_weights(durable(features(docs)), **options)).select(*[F.col(d).alias(n) for d, n in names.items()])
    own = {d: F.coalesce(docs[d].cast("string"), F.lit("unknown")) for d in ("source", "lang")} | {"topic": topic_column(docs)}
    same = [own[d] == F.col(names[d]) for d in DIMENSIONS]
    chosen = unit_hash(docs["doc_id"], SALT) < F.col(names["probability"])
    return docs.join(cells, same[0] & same[1] & same[2] & chosen, "left_semi")


def oracle() -> str:
    """The same fit in SQL, one common table expression a step."""
    low = "lower(coalesce(text, ''))"
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    hits = {name: " + ".join(f"contains({low}, {quoted(w)})::INT" if w != "\t" else f"contains({low}, chr(9))::INT" for w in words) for name, words in TOPICS.items()}
    cases = " ".join(f"WHEN h_{name} = greatest({', '.join('h_' + n for n in hits)}) THEN '{name}'" for name in hits)
    steps = [
        f"""f0 AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, {', '.join(f'({h}) AS h_{n}' for n, h in hits.items())} FROM documents)""",
        f"f AS MATERIALIZED (SELECT doc_id, source, lang, n_tokens, CASE WHEN greatest({', '.join('h_' + n for n in hits)}) = 0 THEN 'general' {cases} END AS topic FROM f0)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM f GROUP BY ALL)",
        "k0 AS MATERIALIZED (SELECT *, t AS r, " + ", ".join(f"pow(sum(t) OVER (PARTITION BY {d}), {TEMPER}) AS g_{d}, count(*) OVER (PARTITION BY {d}) AS p_{d}" for d in DIMENSIONS) + " FROM c)",
        "r0 AS MATERIALIZED (SELECT source, lang, topic, t, r, " + ", ".join(f"g_{d} / sum(g_{d} / p_{d}) OVER () * sum(t) OVER () AS g_{d}" for d in DIMENSIONS) + " FROM k0)",
    ]
    n = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            steps.append(f"r{n + 1} AS MATERIALIZED (SELECT source, lang, topic, t, CASE WHEN sum(r) OVER (PARTITION BY {d}) > 0 THEN r * g_{d} / sum(r) OVER (PARTITION BY {d}) ELSE 0 END AS r, g_source, g_lang, g_topic FROM r{n})")
            n += 1
    order = "ORDER BY w DESC, source, lang, topic"
    steps += [
        f"w AS MATERIALIZED (SELECT source, lang, topic, t, CASE WHEN t > 0 THEN r / t ELSE 1.0 END AS w, sum(t) OVER () * {SHARE} AS wanted FROM r{n})",
        f"x AS MATERIALIZED (SELECT *, coalesce(sum(t) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fl, sum(t * w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w)",
        "y AS MATERIALIZED (SELECT *, (wanted - fl) / nullif(rest, 0) AS s FROM x)",
        "z AS (SELECT first(s ORDER BY w DESC, s DESC) AS s FROM y WHERE s * w <= 1)",
        f"q AS (SELECT source, lang, topic, round(w, 9) AS weight, round(CASE WHEN t > 0 THEN least(1.0, greatest(0.0, coalesce(z.s * w, 1.0))) ELSE {SHARE} END, 9) AS probability FROM y CROSS JOIN z)",
    ]
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, weight, probability, ('0x' || substr(md5(doc_id::VARCHAR || ':{SALT}'), 1, 13))::BIGINT / {float(2**52)} < probability AS sampled FROM f JOIN q USING (source, lang, topic)"
