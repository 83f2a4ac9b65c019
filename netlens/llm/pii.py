"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base spans (email, ip, card, phone) are the protected entities. The words of a document,
outside its base spans, are the terms of its entities. Over the whole corpus, a term t reveals an
entity e as far as

    PMI(t; e) / IC(e),   PMI = log p(e | t) / p(e),   IC(e) = -log p(e)

that is, as the share of e's information that is known once t is read. Terms found in
at least ``SUPPORT`` documents with e that reach the disclosure threshold are spans too,
wherever they stand, in documents with and without base spans.
A base span is generalised to its kind; a disclosing term is generalised to a
placeholder or removed.

Every pair of a term and an entity with that support is rated. Reaching the threshold
needs n(t) <= n(e) / p(e) ** (1 - threshold), so terms that are too frequent for an entity
are never paired with it. Disclosing terms meet the words of all documents in an equi-join,
and only documents with a match are read again for the places.

Base rules, leftmost and without overlap within a kind: see ``KINDS``. The expressions
used here are equivalent to those rules but scan a text once, whatever it holds: runs are
possessive and start where a run starts or where the last match ended.

Defined results for odd input: a null text counts as empty; empty texts have no spans;
repeated rows are counted as the rows they are, on both sides of every ratio, and get equal
spans; spans of several kinds may overlap, and overlapping ones are replaced together, under
the kind that is listed first; a row with a null id is read and sanitised like any other but
takes no part in the corpus counts; an empty table gives an empty result; texts may be of any
length. Only id and text are read; a row is known by 128 bits of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netlens.llm.common import checkpointed, free_name

#: The base rules as they are stated.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SUPPORT, DISCLOSURE = 2, 0.9
#: Bytes of disclosing terms up to which they are broadcast; beyond, they are joined by shuffle.
BROADCAST_BYTES = 4 << 20
#: A term in more than this share of documents is hot: there are few of them, and they are kept out of shuffles.
HOT = 0.001

_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,}+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_NOT_CARD = r"[^0-9]{2,}|[^0-9 \-]"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """True where a string of 12 to 19 digits passes the check."""
    one = f"transform(sequence(1, length({digits})), i -> struct(i, cast(substring(reverse({digits}), i, 1) as int) as d))"
    return f"(aggregate({one}, 0, (s, x) -> s + case when x.i % 2 = 1 then x.d when x.d > 4 then 2 * x.d - 9 else 2 * x.d end) % 10 = 0)"


def _spans(kind: str) -> str:
    """SQL: array of struct(kind, s, e, v) of the valid spans of one kind in column ``text``."""
    if kind == "card":
        pieces, gaps, quick = f"split(text, {_sql(_NOT_CARD)}, -1)", f"regexp_extract_all(text, {_sql(_NOT_CARD)}, 0)", r"[0-9][0-9 \-]{10,}[0-9]"
        # a lone blank or hyphen may lead the first piece or trail the last
        item = "named_struct('s', a.at + length(p.x) - length(ltrim(' -', p.x)), 'v', trim(BOTH ' -' FROM p.x))".replace("ltrim(' -', p.x)", "trim(LEADING ' -' FROM p.x)")
        walk = (
            f"aggregate(zip_with({pieces}, {gaps}, (x, g) -> struct(x, coalesce(length(g), 0) as g)), "
            f"named_struct('at', 0, 'out', cast(array() as array<struct<s:int,v:string>>)), "
            f"(a, p) -> named_struct('at', a.at + length(p.x) + p.g, 'out', case when length(p.x) < 12 then a.out else array_append(a.out, {item}) end), a -> a.out)"
        )
        size = f"length({_digits('m.v')})"
        valid = f"case when {size} between 12 and 19 then {_luhn(_digits('m.v'))} else false end"
    else:
        pattern, quick = {"email": (_EMAIL, "@"), "ip": (_IP, r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), "phone": (_PHONE, r"\+[0-9]")}[kind]
        gaps, found = f"split(text, {_sql(pattern)}, -1)", f"regexp_extract_all(text, {_sql(pattern)}, 0)"
        walk = (
            f"aggregate(zip_with({found}, {gaps}, (x, g) -> struct(x, length(g) as g)), "
            f"named_struct('at', 0, 'out', cast(array() as array<struct<s:int,v:string>>)), "
            f"(a, p) -> named_struct('at', a.at + p.g + coalesce(length(p.x), 0), 'out', case when p.x is null then a.out else array_append(a.out, named_struct('s', a.at + p.g, 'v', p.x)) end), a -> a.out)"
        )
        valid = {
            "email": "true",
            "ip": f"m.v rlike {_sql(f'^{_BYTE}[.]{_BYTE}[.]{_BYTE}[.]{_BYTE}$')}",
            "phone": f"length({_digits('m.v')}) between 9 and 15",
        }[kind]
    order = list(KINDS).index(kind)
    made = f"transform(filter({walk}, m -> {valid}), m -> named_struct('s', m.s, 'k', {order}, 'e', m.s + length(m.v), 'v', m.v))"
    none = "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"
    test = "contains(text, '@')" if kind == "email" else f"text rlike {_sql(quick)}"
    return f"case when {test} then {made} else {none} end"


_WORD = r"[\p{L}\p{N}_'-]++"
#: Stands for a base span in a text whose other words are read: a word that it touches is not one.
_MASK = "\ue000"
_MASKED = r"[\p{L}\p{N}_'\x{E000}-]++"
_USABLE = "length(t) > 2 and t rlike '[a-zA-Z]|[^\\\\x00-\\\\x7F]'"
_NONE = "cast(array() as array<struct<s:int,k:int,e:int,v:string>>)"


def _entity(b: str) -> str:
    """SQL: what is protected, written one way: lower case, or digits alone for cards and phones."""
    return f"concat({b}.k, ':', case when {b}.k < 2 then lower({b}.v) else {_digits(f'{b}.v')} end)"


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text, base: array of (s, k, e, v) by start, then kind; code points, end exclusive."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.withColumn("base", F.expr(f"array_sort(concat({', '.join(map(_spans, KINDS))}))"))


def _distinct_words(docs: DataFrame, *keys: str) -> DataFrame:
    """The given columns and term: each word of a text once."""
    words = docs.select(*keys, F.explode(F.expr(f"array_distinct(regexp_extract_all(lower(text), {_sql(_WORD)}, 0))")).alias("t"))
    return words.where(F.expr(_USABLE)).select(*keys, F.col("t").alias("term"))


def terms_beside(spans: DataFrame) -> DataFrame:
    """row, term: the words of documents with entities, of three letters or more and outside base spans."""
    masked = (
        "aggregate(base, named_struct('at', 0, 'out', ''), (a, b) -> named_struct('at', greatest(a.at, b.e), "
        f"'out', concat(a.out, substring(text, a.at + 1, greatest(0, b.s - a.at)), '{_MASK}')), a -> concat(a.out, substring(text, a.at + 1)))"
    )
    words = spans.select("row", F.explode(F.expr(f"array_distinct(regexp_extract_all(lower({masked}), {_sql(_MASKED)}, 0))")).alias("t"))
    return words.where(F.expr(f"not contains(t, '{_MASK}') and {_USABLE}")).select("row", F.col("t").alias("term"))


def disclosing(whole: DataFrame, scanned: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """(term, entity, n, n_term, revealed): terms that reveal an entity, by co-occurrence over all documents.

    ``whole`` has the id and text of every document, ``scanned`` (doc_id, row, base) of every document and the text of those with spans.
    """
    whole, scanned = whole.where(F.col("doc_id").isNotNull()), scanned.where(F.col("doc_id").isNotNull())
    total = max(1, scanned.count())
    with_spans = scanned.where(F.size("base") > 0)
    held = with_spans.select("row", F.explode(F.expr(f"array_distinct(transform(base, b -> {_entity('b')}))")).alias("entity"))
    held = held.groupBy("row", "entity").agg(F.count("*").alias("copies"))  # repeated rows count as often as they are there
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_entity")).where((F.col("n_entity") >= support) & (F.col("n_entity") < total))
    # n <= n_entity, so no term in more documents than this can reach the threshold
    most = F.col("n_entity") / F.pow(F.col("n_entity") / F.lit(total), F.lit(1 - disclosure)) * 1.000001
    entities = checkpointed(entities.withColumn("most", most))
    limit = entities.agg(F.max("most")).first()[0] or 0.0
    counted = checkpointed(_distinct_words(whole).groupBy("term").agg(F.count("*").alias("n_term")).where(F.col("n_term") >= support))
    hot = counted.where((F.col("n_term") > limit) & (F.col("n_term") > HOT * total)).select("term")
    named = held.join(entities, "entity")
    near = terms_beside(with_spans.dropDuplicates(["row"]).join(named.select("row").distinct(), "row", "left_semi"))
    near = near.join(F.broadcast(hot), "term", "left_anti").join(counted.where(F.col("n_term") <= limit), "term")
    pairs = near.join(named, "row").where(F.col("n_term") <= F.col("most"))
    rated = pairs.groupBy("term", "entity").agg(F.sum("copies").alias("n"), F.first("n_term").alias("n_term"), F.first("n_entity").alias("n_entity")).where(F.col("n") >= support)
    given, alone = F.col("n") / F.greatest("n_term", "n"), F.col("n_entity") / F.lit(total)
    revealed = F.log(given / alone) / -F.log(alone)
    return rated.withColumn("revealed", revealed).where(F.col("revealed") >= disclosure).select("term", "entity", "n", "n_term", "revealed")


def row_key(doc_id: str, text: str):
    """128 bits of an id and a text: what rows are known by."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.concat(F.lit("="), F.col(doc_id).cast("string")), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))))


def found_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """doc_id, row, base, added: one row per input row. ``added`` has (s, e, t) of disclosing terms; ``row`` is the key of id and text."""
    whole = base_spans(docs, doc_id, text).withColumn("row", row_key("doc_id", "text"))
    # one scan keeps the spans of every document, and the text of those that have any
    scanned = checkpointed(whole.select("doc_id", "row", "base", F.when(F.size("base") > 0, F.col("text")).alias("text")))
    texts = whole.select("doc_id", "row", "text")
    terms = checkpointed(disclosing(texts, scanned, support, disclosure).select("term").distinct())
    size = terms.agg(F.sum(F.length("term") + 16)).first()[0] or 0
    if not size:
        return scanned.select("doc_id", "row", "base", F.expr("cast(null as array<struct<s:int,e:int,t:string>>)").alias("added"))
    hits = _distinct_words(texts, "row").join(F.broadcast(terms) if size <= BROADCAST_BYTES else terms, "term").groupBy("row").agg(F.collect_set("term").alias("terms"))  # those of one document
    met = texts.join(hits, "row").dropDuplicates(["row"]).join(scanned.select("row", "base").dropDuplicates(["row"]), "row")
    places = (
        f"aggregate(zip_with(regexp_extract_all(text, {_sql(_WORD)}, 0), split(text, {_sql(_WORD)}, -1), (x, g) -> struct(x, length(g) as g)), "
        "named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,t:string>>)), "
        "(a, p) -> named_struct('at', a.at + p.g + coalesce(length(p.x), 0), 'out', case when p.x is not null and array_contains(terms, lower(p.x)) "
        "then array_append(a.out, named_struct('s', a.at + p.g, 'e', a.at + p.g + length(p.x), 't', lower(p.x))) else a.out end), a -> a.out)"
    )
    added = met.select("row", F.expr(f"filter({places}, w -> not exists(base, b -> b.s < w.e and w.s < b.e))").alias("added"))
    return scanned.select("doc_id", "row", "base").join(added, "row", "left")


def _written(spans: str) -> str:
    """SQL: kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in [*KINDS, "term"])
    return f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')"


_ALL = f"array_sort(concat(transform(base, b -> struct(b.s as s, b.k as k, b.e as e)), transform(coalesce(added, array()), t -> struct(t.s as s, {len(KINDS)} as k, t.e as e))))"


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans, n_terms."""
    counts = [F.expr(f"cast(size(filter(base, b -> b.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(F.expr(_written("base")), 256).alias("base_sha256"), F.expr(_written(_ALL)).alias("spans"),
        F.expr("cast(coalesce(size(added), 0) as bigint)").alias("n_terms"),
    )


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosure: float = DISCLOSURE, remove_terms: bool = False) -> DataFrame:
    """The input rows with base spans generalised to their kind and disclosing terms generalised or removed.

    A changed text also renews ``n_chars`` where that column exists; other columns are as they were.
    """
    found = found_spans(docs, doc_id, text, support, disclosure).where("size(base) > 0 or size(added) > 0")
    merged = (
        f"aggregate({_ALL}, cast(array() as array<struct<s:int,k:int,e:int>>), (a, x) -> case when size(a) > 0 and x.s < element_at(a, -1).e "
        "then concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'k', least(element_at(a, -1).k, x.k), 'e', greatest(element_at(a, -1).e, x.e)))) "
        "else array_append(a, x) end)"
    )
    key, cut, old = (free_name(docs, n) for n in ("row", "cuts", "old"))
    # at most one row for each id and text, so the join adds no rows
    cuts = found.select(F.col("row").alias(key), F.expr(merged).alias(cut)).dropDuplicates([key])
    marks = ", ".join([*(f"'[{k.upper()}]'" for k in KINDS), "''" if remove_terms else "'[TERM]'"])
    changed = (
        f"aggregate({cut}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.e, "
        f"'out', concat(a.out, substring({old}, a.at + 1, x.s - a.at), array({marks})[x.k])), a -> concat(a.out, substring({old}, a.at + 1)))"
    )
    met = docs.withColumn(key, row_key(doc_id, text)).join(cuts, key, "left").withColumn(old, F.col(text))
    met = met.withColumn(text, F.when(F.col(cut).isNull(), F.col(old)).otherwise(F.expr(changed)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        met = met.withColumn("n_chars", F.when(F.col(cut).isNull(), F.col("n_chars")).otherwise(F.length(text).cast(kind)))
    return met.select(docs.columns)
