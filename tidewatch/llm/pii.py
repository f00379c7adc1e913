"""Personal data: protected entities by pattern, and the terms that reveal them. Native operations only.

Protected entities are e-mail and IP addresses, card and phone numbers. How much a term reveals of an entity
is estimated from the whole corpus: with document frequencies, the pointwise mutual information of term and
entity, as a share of the entity's own information, is 1 if the term never occurs without the entity and 0
if it is independent of it. Terms within ``WINDOW`` words of an entity are candidates. From the share
``GENERALISE`` on a term is generalised to a tag, from ``REMOVE`` on it is removed, wherever it stands.

An entity is a value (digits only for cards and phones) and, since most values are too rare to tell anything alone,
also the whole kind: a term that stands by e-mail addresses of any value reveals that one is there.

Copies of one passage are one observation, not many: each different context (the words before and after it
together) counts once, for the entity, for the pair and for the term; a document counts once for an entity. A pair
needs ``SUPPORT`` observations; no entity is left out.

Defined results: positions are code points, ends exclusive; the kinds' patterns are searched apart, so spans of
two kinds may overlap (sanitising merges them); a match that fails its check is dropped and not tried again;
null, empty and white texts have no spans; very long texts are searched whole, in linear time but for the copying of
their matches; a share just at a threshold counts as over it. No documents, no rows. A repeated row has its own
spans and is the same document in the corpus counts; rows without doc_id are sanitised, but count for no entity.
``find_spans`` adds columns named as the kinds, ``general`` and ``term``, in place of columns of those names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.decontaminate import words_of
from tidewatch.sources.scratch import cut

KINDS = ("email", "ip", "card", "phone")
WINDOW, SUPPORT, GENERALISE, REMOVE = 5, 3, 0.6, 0.9
#: Up to so many revealing terms are broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 200_000

#: The contract's patterns. They never give back what they took (possessive), and a match begins where a run of
#: its first characters does or where the last match ended, which finds the same matches in linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
_SIGNS = {"email": "@", "ip": ".", "phone": "+"}
_TAGS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "general": "[TERM]", "term": ""}
_SPAN = "array<struct<start:int,end:int,value:string>>"
_WORD = r"[^\x20\x09-\x0D]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    backwards = F.reverse(digits)

    def step(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _small(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.concat(F.lit("0"), F.substring(short, 1, 3)).cast("int") <= 255)


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the kind's pattern passes its check."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small)
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _find(text: Column, pattern: str, check) -> Column:
    """Spans of the matches that pass a check, in order. The text between matches gives their positions."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("before"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        more = F.array_append(acc["found"], F.struct(start.alias("start"), end.alias("end"), x["match"].alias("value")))
        keep = F.when(x["match"].isNull(), False).otherwise(check(x["match"]))
        return F.struct(end.alias("at"), F.when(keep, more).otherwise(acc["found"]).alias("found"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))
    return F.aggregate(parts, first, step, lambda acc: acc["found"])


def _all(kinds: Iterable[str], made: Callable[[str], Callable[[Column], Column]]) -> Column:
    """The spans of several kinds (columns) in one array, each as ``made(kind)`` makes it."""
    return F.concat(*[F.transform(k, made(k)) for k in kinds])


def entity_spans(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of one kind of personal data."""
    text = F.coalesce(text, F.lit(""))
    present = text.contains(_SIGNS[kind]) if kind in _SIGNS else F.lit(True)
    return F.when(present & text.rlike("@" if kind == "email" else "[0-9]"), _find(text, PATTERNS[kind], lambda m: valid(kind, m))).otherwise(F.array().cast(_SPAN))


def _contexts(found: DataFrame) -> DataFrame:
    """row, doc_id, kind, value, before, after (words) of each entity in ``found(row, doc_id, text, email, ip, card, phone)``."""
    spans = _all(KINDS, lambda k: lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (_digits(s["value"]) if k in ("card", "phone") else F.lower(s["value"])).alias("value")))
    each = found.where(F.size(spans) > 0).select("doc_id", "text", F.explode(spans).alias("s"))
    reach = 40 * WINDOW
    before = F.expr(f"substring(text, greatest(1, s.start + 1 - {reach}), least(s.start, {reach}))")
    after = F.expr(f"substring(text, s.end + 1, {reach})")
    left, right = words_of(before), words_of(after)
    return each.select("doc_id", "s.kind", "s.value", F.slice(left, F.greatest(F.size(left) - WINDOW + 1, F.lit(1)), WINDOW).alias("before"), F.slice(right, 1, WINDOW).alias("after"))


def revealing_terms(found: DataFrame) -> DataFrame:
    """term, share, action: the terms of a corpus that reveal a protected entity. ``found`` as from ``find_entities``."""
    contexts = cut(_contexts(found), "contexts")
    # An entity of each value, and one of the whole kind (no value).
    entity = F.explode(F.array(F.col("value"), F.lit(None).cast("string"))).alias("value")
    contexts = contexts.select("doc_id", "kind", entity, F.xxhash64("before", "after").alias("context"), "before", "after")
    documents, observed = F.count_distinct("doc_id"), F.least(F.count_distinct("context"), F.count_distinct("doc_id"))
    entities = contexts.groupBy("kind", "value").agg(observed.alias("n_entity"))
    near = contexts.select("doc_id", "kind", "value", "context", F.explode(F.array_distinct(F.concat("before", "after"))).alias("word"))
    near = near.select("doc_id", "kind", "value", "context", _bare("word").alias("term")).where(F.length("term") > 1)
    pairs = near.groupBy("kind", "value", "term").agg(observed.alias("n_both"), documents.alias("n_near")).where(F.col("n_both") >= SUPPORT)
    same = (pairs["kind"] == entities["kind"]) & pairs["value"].eqNullSafe(entities["value"])
    pairs = cut(pairs.join(F.broadcast(entities) if entities.count() <= BROADCAST_ROWS else entities, same).select("term", "n_both", "n_near", "n_entity"), "pairs")
    terms = pairs.select("term").distinct()
    terms = F.broadcast(terms) if terms.count() <= BROADCAST_ROWS else terms
    words = found.select(F.explode(F.array_distinct(F.transform(words_of(F.col("text")), _bare))).alias("term"))
    counts = words.join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    total = found.count()
    once = F.col("n_term") - (F.col("n_near") - F.col("n_both"))  # documents with the term, copies of a context once
    mutual = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_entity") * once))
    share = mutual / F.log((F.lit(float(total)) + 1) / F.col("n_entity"))
    out = pairs.join(counts, "term").groupBy("term").agg(F.max(share).alias("share")).where(F.col("share") >= GENERALISE)
    return out.withColumn("action", F.when(F.col("share") >= REMOVE, "term").otherwise("general"))


def _bare(word: Column | str) -> Column:
    """A word without outer punctuation."""
    return F.regexp_replace(word, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def find_entities(docs: DataFrame) -> DataFrame:
    """``docs`` with a column for each kind's spans."""
    return docs.withColumns({k: entity_spans(F.col("text"), k) for k in KINDS})


def find_spans(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs(key, text)`` with the spans of each kind, and of terms to generalise or remove (``general``, ``term``)."""
    base = docs.select(F.col(key).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    terms = cut(revealing_terms(find_entities(base)), "terms")
    n_terms = terms.count()
    found = find_entities(docs)
    empty = F.array().cast(_SPAN)
    if not n_terms:
        return found.withColumns({"general": empty, "term": empty})
    # Texts are joined to the terms by their words; only rows that hold one get spans of terms.
    small = F.broadcast(terms) if n_terms <= BROADCAST_ROWS else terms
    holders = base.select(F.xxhash64("doc_id", "text").alias("row"), F.explode(F.array_distinct(F.transform(words_of(F.col("text")), _bare))).alias("term")).join(small, "term")
    holders = holders.groupBy("row").agg(*[F.collect_set(F.when(F.col("action") == a, F.col("term"))).alias(f"terms_{a}") for a in ("general", "term")])
    found = found.withColumn("row", F.xxhash64(F.col(key), F.coalesce("text", F.lit("")))).join(holders, "row", "left")

    def spans(action: str) -> Column:
        own = F.col(f"terms_{action}")
        return F.when(F.size(own) > 0, _find(F.coalesce("text", F.lit("")), _WORD, lambda m: F.array_contains(own, _bare(F.translate(m, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))).otherwise(empty)

    return found.withColumns({a: spans(a) for a in ("general", "term")}).drop("row", "terms_general", "terms_term")


def sanitised(text: Column) -> Column:
    """The text with its spans (columns of ``find_spans``) replaced by tags or removed; overlapping spans go together."""
    tagged = _all(_TAGS, lambda k: lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(_TAGS[k]).alias("tag")))

    def step(acc: Column, s: Column) -> Column:
        end = -s["end"]
        out = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), s["tag"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], out).otherwise(acc["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rest = F.aggregate(F.sort_array(tagged), first, step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(tagged) > 0, rest).otherwise(text)


def sanitise(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with the personal data of ``text`` tagged or removed; other columns stay as they are."""
    aside = docs.select(F.struct(*docs.columns).alias("kept"), F.col(key).alias("doc_id"), "text")
    clean = find_spans(aside).withColumn("clean", sanitised(F.col("text")))
    return clean.select(*[F.col("clean").alias("text") if c == "text" else F.col("kept").getField(c).alias(c) for c in docs.columns])


def pii_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the kinds, hash of their spans, all spans."""
    found = find_spans(docs.select("doc_id", "text"))

    def joined(kinds: tuple[str, ...]) -> Column:
        return F.concat_ws(",", _all(kinds, lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))))

    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(KINDS), 256).alias("base_sha256"), joined((*KINDS, "general", "term")).alias("spans"))
