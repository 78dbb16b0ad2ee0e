r"""Personal data: exact patterns, then information-theoretic sanitisation of the terms that give protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern in whole texts. Each
distinct value found is a protected entity, and so are the parts that many values share (the name and the host of an address, the
network of an IP address, the issuer of a card), unless ``parts`` is off. The corpus says how much a term t reveals of an entity e:
with document counts over all distinct texts (copies are no independent evidence), PMI(e; t) = log(p(e, t) / (p(e) p(t))) and IC(e) = -log p(e); PMI / IC is 1 when t occurs only in
documents that hold e, and 0 when they are independent. Every term of a document that holds e is judged, wherever it stands.
Where the ratio reaches ``GENERALISE``, every occurrence of the term in the documents that hold e gets a span of kind
``generalise`` (the value is replaced by its shape), from ``REMOVE`` on of kind ``remove``. Chance must be ruled out: of the
terms told for an entity an expected share of ``FALSE_SHARE`` at most may share so many documents with it by chance (Benjamini
and Hochberg's procedure over all distinct terms of the corpus). No number of documents is asked for: the terms that only the two
documents of an entity have are told in a common corpus, those of a single document where documents outnumber the distinct
terms by far; elsewhere they can't be told from words that are merely rare, and stay. ``false_share=float("inf")`` lifts that
test and leaves the plain threshold.

All of it is DataFrame functions. Patterns start only where a run of their characters starts or where the last match
ended, which gives the same matches as the plain patterns without trying every start of a long run. Texts are scanned for
patterns once; terms are looked up only in texts with a hit. Entities that stand in the same documents count as one, and a
term is paired only with entities whose ratio it can reach by its document count, which loses none; pairs are counted with
map-side combine.

Defined cases: null text counts as empty; rows of equal texts (by MD5) get equal spans and count as one document; very long texts
are scanned whole, their matches in blocks; terms of equal ratio and chance are told or kept together; an empty table gives an
empty result; other columns are ignored. A term is three letters or more: numbers and shorter words are never judged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.common import durable, text_or_empty

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("generalise", "remove")
#: Each pattern finds what the plain one finds: a match may begin where no run of its characters goes on, or at the last match's end.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
GENERALISE, REMOVE, FALSE_SHARE, SUBSET = 0.9, 0.999, 0.01, 64
#: A term is a whole run of letters that is no part of an address.
TERM = r"(?<![\p{L}\p{M}\p{N}@._%+-])\p{L}[\p{L}\p{M}]{2,}+(?![\p{N}@_%+-]|\.[\p{L}\p{N}])"
SPAN = "array<struct<start:int,end:int,kind:string,value:string>>"
PAIRS, BLOCK = "array<struct<value:string,gap:string>>", 128
#: An entity of more distinct texts than one in HOT_SHARE of all mentions (and HOT_LEAST) is joined by broadcast: HOT_SHARE entities at most.
HOT_LEAST, HOT_SHARE, SALTS = 10_000, 1000, 16


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    backwards = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(F.reverse(digits), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(backwards, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$"),
        "card": F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def _positions(text: Column, kind: str) -> Column:
    """The valid matches of a kind with their places: what lies between the matches tells where each begins."""
    found, gaps = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    empty = F.array().cast(SPAN)

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(_valid(kind, x["value"]), F.concat(s["spans"], one)).otherwise(s["spans"]).alias("spans"))

    def block(s: Column, part: Column) -> Column:
        # spans are gathered by block, and blocks then joined, so that no long array is copied for each match
        done = F.aggregate(part, F.struct(s["at"].alias("at"), empty.alias("spans")), step)
        return F.aggregate(F.array(done), s, lambda t, d: F.struct(d["at"].alias("at"), F.array_append(t["parts"], d["spans"]).alias("parts")))

    # zipped, both arrays are made once; the text after the last match has no value and is not needed
    pairs = F.filter(F.arrays_zip(found.alias("value"), gaps.alias("gap")), lambda x: x["value"].isNotNull())
    blocks = F.aggregate(F.array(pairs), F.array().cast(f"array<{PAIRS}>"), lambda _, all_pairs: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_pairs) - 1) / BLOCK).cast("int")), lambda k: F.slice(all_pairs, k * BLOCK + 1, BLOCK)))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts"))
    return F.when(F.size(found) > 0, F.flatten(F.aggregate(blocks, state, block)["parts"])).otherwise(empty)


_MAY_HOLD = {"email": lambda t: t.contains("@"), "ip": lambda t: t.contains("."), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), "phone": lambda t: t.contains("+")}


def scan(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Stored, one row per row of docs: doc_id, content (MD5 of the text), spans (by start, then kind), text (of rows with spans only, unless keep_text)."""
    text = text_or_empty()
    empty = F.array().cast(SPAN)
    found = F.concat(*[F.when(_MAY_HOLD[k](text), _positions(text, k)).otherwise(empty) for k in KINDS])
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value"))))
    spans = F.transform(ordered, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["value"].alias("value")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("found", found)
    held = F.col("text") if keep_text else F.when(F.size("found") > 0, F.col("text"))
    return durable(rows.select("doc_id", F.md5("text").alias("content"), held.alias("text"), F.when(F.size("found") > 0, spans).otherwise(empty).alias("spans")))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def distinct_texts(rows: DataFrame, *more: str) -> DataFrame:
    """content, text and more columns that depend on it, once for each distinct text; copies are combined before the shuffle."""
    return rows.groupBy("content").agg(*[F.first(c).alias(c) for c in ("text", *more)])


def _entities(span: Column, parts: bool) -> Column:
    """The protected entities of a span: its value and, if wanted, the parts of it that other values share."""
    value = F.lower(span["value"])
    digits = _digits(value)
    shared = {
        "email": [F.concat(F.lit("name:"), F.substring_index(value, "@", 1)), F.concat(F.lit("host:"), F.substring_index(value, "@", -1))],
        "ip": [F.concat(F.lit("network:"), F.substring_index(value, ".", 3))],
        "card": [F.concat(F.lit("issuer:"), F.substring(digits, 1, 6))],
    }
    found = F.array(F.concat_ws(":", span["kind"], value))
    if parts:
        for kind, names in shared.items():
            found = F.when(span["kind"] == kind, F.concat(F.array(F.concat_ws(":", span["kind"], value)), F.array(*names))).otherwise(found)
    return found


def _groups(hits: DataFrame, parts: bool) -> DataFrame:
    """content, grp, n_entity: the entities of each distinct text; those that stand in the same texts are one group."""
    held = durable(hits.select("content", F.explode(F.array_distinct(F.flatten(F.transform("spans", lambda x: _entities(x, parts))))).alias("entity")))
    # two hashes over the set of texts, 128 bits, tell the sets apart
    texts = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("content")).alias("x"), F.bit_xor(F.xxhash64(F.lit("texts"), F.col("content"))).alias("y"))
    grouped = durable(held.groupBy("entity").agg(texts.alias("grp")))
    hot = F.col("grp.n") > max(HOT_LEAST, held.count() // HOT_SHARE)
    large = F.broadcast(grouped.where(hot))
    joined = held.join(large, "entity").unionByName(held.join(large, "entity", "left_anti").join(grouped.where(~hot), "entity"))
    return joined.select("content", "grp", F.col("grp.n").alias("n_entity")).distinct()


def chance(n_both: Column, n_entity: Column, n_term: Column, n_docs: Column) -> Column:
    """A bound on the logarithm of the probability that an independent entity and term share n_both documents or more: the better of
    Hoeffding's (valid without replacement) and the expected number of sets of up to ``SUBSET`` documents that both have."""

    def bound(drawn: Column, others: Column) -> Column:
        p, q = n_both / drawn, others / n_docs
        rest = F.when(p < 1, (1 - p) * F.log((1 - p) / F.nullif(1 - q, F.lit(0.0)))).otherwise(0.0)
        return F.when(p > q, -drawn * (p * F.log(p / q) + rest)).otherwise(0.0)

    k = F.least(n_both, F.lit(SUBSET)).cast("int")
    each = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.log((n_entity - i) * (n_term - i) / ((n_docs - i) * (k - i))))
    return F.least(bound(n_entity, n_term), bound(n_term, n_entity), F.aggregate(each, F.lit(0.0), lambda s, x: s + x))


def disclosures(docs: DataFrame, scanned: DataFrame, hits: DataFrame, generalise: float = GENERALISE, false_share: float = FALSE_SHARE, parts: bool = True) -> DataFrame:
    """content, term, ratio: the terms of each distinct text that give away an entity of it, and how much of its information at most.

    hits: content, text, spans of the distinct texts with spans."""
    texts = distinct_texts(docs.select(text_or_empty().alias("text")).withColumn("content", F.md5("text")))
    in_docs = durable(texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term")))
    sizes = scanned.agg(F.count_distinct("content").alias("n_docs")).crossJoin(in_docs.agg(F.count(F.lit(1)).alias("n_terms")))
    # n_both is n_entity at most, so a term of more documents than this stays below the ratio
    most = F.col("n_entity") * F.pow(F.col("n_docs") / F.col("n_entity"), F.lit(1 - generalise)) * (1 + 1e-9)
    groups = durable(_groups(hits, parts).crossJoin(F.broadcast(sizes)).withColumn("most", most))
    reach = F.broadcast(groups.agg(F.max("most").alias("reach")))
    counted = hits.select("content", F.explode(_words(F.col("text"))).alias("term")).join(in_docs.join(reach, F.col("n_term") <= F.col("reach")).drop("reach"), "term")
    pairs = durable(groups.join(counted, "content").where(F.col("n_term") <= F.col("most")).drop("most"))
    both = pairs.groupBy("grp", "term").agg(F.count(F.lit(1)).alias("n_both"), *[F.first(c).alias(c) for c in ("n_entity", "n_term", "n_docs", "n_terms")])
    information = -F.log(F.col("n_entity") / F.col("n_docs"))
    ratio = 1 + F.log(F.col("n_both") / F.col("n_term")) / F.nullif(information, F.lit(0.0))
    judged = both.select("grp", "term", ratio.alias("ratio"), chance(*map(F.col, ("n_both", "n_entity", "n_term", "n_docs"))).alias("chance"), "n_terms")
    # Benjamini and Hochberg's step: the largest chance that is no more than its rank's share of what may be false
    ranked = judged.groupBy("grp", "chance").agg(F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms")).withColumn("rank", F.sum("n").over(Window.partitionBy("grp").orderBy("chance")))
    cut = ranked.where(F.col("chance") <= F.log(F.col("rank") * false_share / F.col("n_terms"))).groupBy("grp").agg(F.max("chance").alias("cut"))
    told = judged.where(F.col("ratio") >= generalise).join(cut, "grp").where("chance <= cut").select("grp", "term", "ratio")
    return pairs.select("content", "grp", "term").join(told, ["grp", "term"]).groupBy("content", "term").agg(F.max("ratio").alias("ratio"))


def _occurrences(rows: DataFrame) -> DataFrame:
    """content, term, start, end: every term of content, text with its place."""
    words = F.regexp_extract_all("text", F.lit(TERM), F.lit(0))
    each = rows.select("content", F.posexplode(F.arrays_zip(words.alias("word"), F.split("text", TERM, -1).alias("gap")))).where(F.col("col.word").isNotNull())
    end = F.sum(F.length("col.gap") + F.length("col.word")).over(Window.partitionBy("content").orderBy("pos")).cast("int")
    return each.select("content", "col.word", end.alias("end")).select("content", F.lower("word").alias("term"), (F.col("end") - F.length("word")).alias("start"), "end")


def find_spans(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, false_share: float = FALSE_SHARE, keep_text: bool = False, parts: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, base and added (arrays of start, end, kind), ordered by start, then kind."""
    scanned = scan(docs, keep_text)
    hits = durable(distinct_texts(scanned.where(F.size("spans") > 0), "spans"))
    told = durable(disclosures(docs, scanned, hits, generalise, false_share, parts))
    kind = F.when(F.col("ratio") >= remove, F.lit("remove")).otherwise(F.lit("generalise"))
    places = _occurrences(hits.join(told.select("content").distinct(), "content", "left_semi").select("content", "text"))
    extra = places.join(told, ["content", "term"]).groupBy("content").agg(F.collect_list(F.struct("start", "end", kind.alias("kind"))).alias("extra"))
    # the spans of a text go back to all its copies, which are dealt out over SALTS tasks
    dealt = extra.select(F.col("content").alias("x_content"), "extra", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("x_salt"))
    salted = scanned.drop(*([] if keep_text else ["text"])).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    joined = salted.join(dealt, (F.col("content") == F.col("x_content")) & (F.col("salt") == F.col("x_salt")), "left")
    plain = "array<struct<start:int,end:int,kind:string>>"
    base = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return joined.select("doc_id", *(["text"] if keep_text else []), base.alias("base"), F.coalesce(F.array_sort("extra"), F.array().cast(plain)).alias("added"))


def _listed(spans: Column) -> Column:
    order = {kind: k for k, kind in enumerate((*KINDS, *ADDED))}
    rank = F.create_map(*[x for kind, k in order.items() for x in (F.lit(kind), F.lit(k))])
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), rank[x["kind"]].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.concat_ws(",", F.transform(ranked, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    found = find_spans(docs, **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """doc_id, text with its spans replaced: by the kind, by the shape of a generalised term, or by nothing."""
    found = find_spans(docs, keep_text=True, **options)
    text = F.col("text")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        value = F.substring(text, x["start"] + 1, x["end"] - x["start"])
        shape = F.when(value.rlike(r"^\p{Lu}"), "[Name]").otherwise("[term]")
        put = F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", shape).otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        clear = x["start"] >= s["at"]
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(clear, F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), put)).otherwise(s["out"]).alias("out"))

    done = F.aggregate(F.array_sort(F.concat("base", "added")), state, step)
    return found.select("doc_id", done.alias("done"), "text").select("doc_id", F.concat(F.col("done.out"), F.substring(text, F.col("done.at") + 1, F.length(text))).alias("text"))
