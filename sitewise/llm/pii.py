"""Information-theoretic sanitisation, in DataFrame functions only.

Base spans: e-mail, ip, card and phone, leftmost non-overlapping per kind. Each
pattern is one ``regexp_replace`` that fences its matches; splitting at the
fences gives matches and gaps, whose lengths add up to code-point offsets. Running sums go
by chunks of ``CHUNK``, and a text is cut into its code points once, so the work stays
close to linear in the number of matches.

Added spans: a base span's value is a protected entity, and every word (letters,
marks and digits, in lower case) that stands outside a document's base spans is a
term of the whole document. Over all documents, with N rows, n(c) rows that hold
entity c, n(t) rows that hold term t and n(c,t) rows that hold both,

    PMI(c;t) = log2(N n(c,t) / (n(c) n(t)))   and   IC(c) = log2(N / n(c)).

A term discloses c where PMI >= alpha * IC and n(c,t) >= support; it is then a
span of kind ``term`` wherever it stands in a document that holds c. ``sanitise``
removes terms that disclose all (PMI >= 0.95 IC) and generalises the others and
the base spans to a label.

Since n(c,t) <= n(c), only terms with n(t) <= n(c) (N / n(c))^(1 - alpha) can reach
alpha; n(t) is counted first, and pairs are made of those only. An entity or term
that a third of all rows hold is counted by pre-aggregation; joins on it read
tables from the shared folder, which AQE splits if skewed. Terms are broadcast
only up to ``small`` of them; beyond, counts are aggregated first and joined by
shuffle.

Edge cases: a null or empty text has no spans. Each row is a document, repeated
rows too. U+0001 and U+0002 in a text are read as U+0003 (no pattern or word has
either). ``find_spans`` reads doc_id and text only; ``sanitise`` keeps extra
columns and replaces spans and sanitised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import table

KINDS = ("email", "ip", "card", "phone")
#: The contract's patterns; possessive where nothing that follows needs a step back. A local
#: part starts where the run before it ends, so that a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SPAN = "array<struct<start:int,ord:int,kind:string,end:int,value:string>>"
CHUNK = 64
ADDED = "array<struct<start:int,end:int,share:double>>"
LETTER = r"\p{L}\p{M}\p{N}"
EDGE = rf"(?<=[{LETTER}])(?=[^{LETTER}])|(?<=[^{LETTER}])(?=[{LETTER}])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def doubled(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.concat(F.lit("0"), F.substring(part(x), 1, 3)).cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once (inside a lambda function, an expression is evaluated at each use)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _before(values: Column, zero: Column, fold) -> Column:
    """For each element, the fold of the elements before it: of whole chunks before, then of its own chunk."""
    def within(v: Column, chunks: Column) -> Column:
        ahead = F.transform(F.sequence(F.lit(0), F.size(chunks)), lambda c: F.aggregate(F.slice(chunks, F.lit(1), c), zero, fold))
        return _with(ahead, lambda a: F.transform(v, lambda _, i: F.aggregate(F.slice(v, i - i % CHUNK + 1, i % CHUNK), F.element_at(a, F.floor(i / CHUNK).cast("int") + 1), fold)))

    def chunks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / CHUNK).cast("int")), lambda c: F.aggregate(F.slice(v, c * CHUNK + 1, F.lit(CHUNK)), zero, fold))

    return _with(values, lambda v: _with(chunks(v), lambda c: within(v, c)))


def _words(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), f"[^{LETTER}]+")), "")


def _outside(text: Column, spans: Column) -> Column:
    """The text with U+0001 for each code point of the (sorted) spans."""
    def piece(s: Column, low: Column, chars: Column) -> Column:
        gap = F.array_join(F.slice(chars, low + 1, F.greatest(s["start"] - low, F.lit(0))), "")
        return F.concat(gap, F.repeat(F.lit("\u0001"), F.greatest(s["end"] - F.greatest(s["start"], low), F.lit(0))))

    def pieces(chars: Column, covered: Column) -> Column:
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        tail = F.array_join(F.slice(chars, last + 1, F.size(chars)), "")
        return F.concat(F.array_join(F.transform(spans, lambda s, i: piece(s, F.element_at(covered, i + 1), chars)), ""), tail)

    covered = _before(F.transform(spans, lambda s: s["end"]), F.lit(0), lambda a, x: F.greatest(a, x))
    return _with(F.split(text, ""), lambda chars: _with(covered, lambda c: pieces(chars, c)))


def _marked(rest: Column, marks: Column) -> Column:
    """Where the terms of ``marks`` (term to share) stand: (start, end, share)."""
    def step(a: Column, x: Column) -> Column:
        end, share = a["at"] + F.length(x), F.try_element_at(marks, F.lower(x))
        here = F.array(F.struct(a["at"].alias("start"), end.alias("end"), share.alias("share")))
        return F.struct(end.alias("at"), F.when(share.isNull(), a["kept"]).otherwise(F.concat(a["kept"], here)).cast(ADDED).alias("kept"))

    return F.aggregate(F.split(rest, EDGE), F.struct(F.lit(0).alias("at"), F.array().cast(ADDED).alias("kept")), step, lambda a: a["kept"])


def _parts(text: Column, kind: str) -> Column:
    """gap, match, gap, ... of a kind's pattern; null without a match."""
    def cut(fenced: Column) -> Column:
        return F.when(F.contains(fenced, F.lit("\u0001")), F.split(fenced, "[\u0001\u0002]"))

    found = _with(F.regexp_replace(text, PATTERNS[kind], "\u0001$0\u0002"), cut)
    if kind in ("email", "phone"):
        found = F.when(F.contains(text, F.lit("@" if kind == "email" else "+")), found)
    return found


def _spans(kind: str) -> Column:
    """The valid spans of one kind, from its parts: (start, ord, kind, end, value)."""
    parts = F.col(kind)

    def span(i: Column, starts: Column) -> Column:
        value, start = F.element_at(parts, (2 * i).cast("int")), F.element_at(starts, (2 * i).cast("int"))
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), (start + F.length(value)).alias("end"), value.alias("value"))

    def spans(starts: Column) -> Column:
        matches = F.filter(F.sequence(F.lit(1), F.floor(F.size(parts) / 2).cast("int")), lambda i: _valid(kind, F.element_at(parts, (2 * i).cast("int"))))
        return F.transform(matches, lambda i: span(i, starts))

    starts = _before(F.transform(parts, F.length), F.lit(0), lambda a, x: a + x)
    return F.when(parts.isNull(), F.array().cast(SPAN)).otherwise(_with(starts, spans).cast(SPAN))


def base_spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash, base (sorted base spans), rest (the text without them; null if
    there are none) and inside (terms that only base spans hold) of each row.

    The texts are read once; matches and gaps of the rows that have some go to a
    table, on which the offsets are worked out.
    """
    text = F.coalesce("text", F.lit(""))
    clean = F.when(text.rlike("[\u0001\u0002]"), F.translate(text, "\u0001\u0002", "\u0003\u0003")).otherwise(text)
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), clean.alias("_t"))
    parts = rows.select("doc_id", "text_hash", "_t", *[_parts(F.col("_t"), k).alias(k) for k in KINDS])
    parts = table(parts.withColumn("_t", F.when(F.coalesce(*[F.col(k) for k in KINDS]).isNotNull(), F.col("_t"))).withColumn("row", F.monotonically_increasing_id()), "parts")
    spread = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = parts.repartition(spread, "row")  # few bytes, much work: over all cores
    spans = table(parts.select("row", "doc_id", "text_hash", "_t", F.array_sort(F.concat(*[_spans(k) for k in KINDS])).alias("base")), "spans")
    rest = spans.withColumn("rest", F.when(F.size("base") > 0, _outside(F.col("_t"), F.col("base"))))
    return rest.select("row", "doc_id", "text_hash", "base", "rest", F.array_except(_words(F.col("_t")), _words(F.col("rest"))).alias("inside"))


def candidates(docs: DataFrame, base: DataFrame, alpha: float = 0.8, support: int = 2, small: int = 200_000) -> DataFrame:
    """(doc_id, text_hash, kind, value, n_c, term, n_t) of each row that holds both, for entities of
    ``support`` rows or more and the terms that can reach ``alpha`` of their IC."""
    total = float(max(1, base.count()))
    found = base.where(F.size("base") > 0)
    own = found.select("row", F.explode(F.array_distinct(F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"))))).alias("c")).select("row", "c.kind", "c.value")
    own = table(own, "held")
    entities = table(own.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= support), "entities")
    holders = own.join(entities, ["kind", "value"]).groupBy("row").agg(F.collect_list(F.struct("kind", "value", "n_c")).alias("c"))
    holders = table(holders.join(found.select("row", "doc_id", "text_hash", "rest"), "row").select("doc_id", "text_hash", "c", _words(F.col("rest")).alias("terms")), "holders")
    wanted = table(holders.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("term"), "terms")
    few = wanted.count() <= small
    near = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    held = docs.select(F.explode(_words(F.coalesce("text", F.lit("")))).alias("term"), F.lit(1).alias("n")).union(found.select(F.explode("inside").alias("term"), F.lit(-1).alias("n")))
    if few:
        held = held.join(near(wanted), "term")
    counts = held.groupBy("term").agg(F.sum("n").alias("n_t"))
    counts = table(counts if few else counts.join(wanted, "term", "left_semi"), "counts")
    pairs = holders.select("doc_id", "text_hash", "c", F.explode("terms").alias("term")).join(near(counts), "term")
    can = lambda c: F.col("n_t") <= c["n_c"] * F.pow(F.lit(total) / c["n_c"], F.lit(1 - alpha)) * (1 + 1e-9)
    pairs = pairs.select("doc_id", "text_hash", "term", "n_t", F.explode(F.filter("c", can)).alias("c"))
    return pairs.select("doc_id", "text_hash", "c.kind", "c.value", "c.n_c", "term", "n_t", F.lit(total).alias("total"))


def disclosing(pairs: DataFrame, alpha: float = 0.8, support: int = 2) -> DataFrame:
    """(kind, value, term, share): terms whose PMI is ``share`` >= alpha of an entity's IC."""
    joint = pairs.groupBy("kind", "value", "term", "n_c", "n_t", "total").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    pmi = F.log2(F.col("total") * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    ic = F.log2(F.col("total") / F.col("n_c"))
    share = F.when(ic > 0, pmi / ic)
    return joint.withColumn("share", share).where(F.col("share") >= alpha).select("kind", "value", "term", "share")


def find_spans(docs: DataFrame, alpha: float = 0.8, support: int = 2) -> DataFrame:
    """doc_id, text_hash, base and added spans of every row; added: (start, end, share)."""
    base = table(base_spans(docs), "base-spans")
    pairs = table(candidates(docs, base, alpha, support), "candidates")
    terms = table(disclosing(pairs, alpha, support), "disclosing")
    hits = pairs.join(terms, ["kind", "value", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.max("share").alias("share"))
    marks = hits.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("marks"))
    marks = marks.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "marks")
    out = base.join(marks, base["doc_id"].eqNullSafe(F.col("_doc")) & (base["text_hash"] == F.col("_hash")), "left")
    added = F.when(F.col("marks").isNotNull(), _marked(F.col("rest"), F.col("marks")))
    return out.select("doc_id", "text_hash", "base", F.coalesce(added, F.array().cast(ADDED)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with spans (start, end, label; not overlapping) and sanitised (the text with labels in their place)."""
    found = find_spans(docs, **options)
    labels = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= 0.95, "").otherwise("[TERM]").alias("label"))))
    apart = F.aggregate(
        F.array_sort(labels), F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("kept")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["kept"], F.array(s)).alias("kept"))), lambda a: a["kept"])
    own = found.select(F.col("doc_id").alias("_sw_doc"), F.col("text_hash").alias("_sw_hash"), apart.alias("spans")).dropDuplicates(["_sw_doc", "_sw_hash"])
    docs = docs.drop("spans", "sanitised")
    joined = docs.join(own, docs["doc_id"].eqNullSafe(F.col("_sw_doc")) & (F.xxhash64(docs["text"]) == F.col("_sw_hash")), "left").drop("_sw_doc", "_sw_hash")
    text = F.coalesce("text", F.lit(""))
    written = F.aggregate(
        "spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["label"]).alias("out")),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return joined.withColumn("sanitised", F.when(F.size("spans") > 0, written).otherwise(text))


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("ord"), F.lit("term").alias("kind"), s["end"].alias("end"))))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.array_sort(every)).alias("spans"))
