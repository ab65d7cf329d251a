"""Personal data: exact patterns, and terms that give protected values away by co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import free, written

# The base patterns. Possessive quantifiers and the look-behind change no match;
# they keep long runs from being tried at each of their characters.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a maximal run of fewer than 13 digits would be dropped, so it need not match
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have before a pattern is tried.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
BYTE = r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"

#: What counts as a term: words of four or more letters.
TERM = r"\p{L}{4,}"
#: Chance at which so many different texts with a value would hold a term that knows nothing
#: of it; pairs above are no evidence. Copies of one text are one, and one is none.
LEVEL = 1e-3
#: Shares of a value's information that a term may disclose: above these it is replaced by its
#: kind of word, or removed.
GENERALISE, REMOVE = 0.5, 0.8


def located(text: Column, pattern: str) -> Column:
    """Matches, leftmost and non-overlapping, as (value, start, end) in code points."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        F.split(text, pattern, -1),
        lambda value, gap: F.struct(value.alias("value"), F.length(gap).alias("gap")),
    )
    return _placed(F.filter(pairs, lambda x: x["value"].isNotNull()))


def _placed(pairs: Column) -> Column:
    """(value, start, end) of values and the gaps before each.

    Appending to an array copies it, so the list is cut into about as many parts as each part has
    values: first the parts' beginnings are added up, then the places within each.
    """
    kind = "array<struct<value:string,start:int,end:int>>"
    size = lambda x: x["gap"] + F.length(x["value"])

    def walk(part: Column, begin: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(begin.alias("at"), F.array().cast(kind).alias("out")),
            lambda a, x: F.struct(
                (a["at"] + size(x)).alias("at"),
                F.array_append(
                    a["out"],
                    F.struct(
                        x["value"].alias("value"),
                        (a["at"] + x["gap"]).alias("start"),
                        (a["at"] + size(x)).alias("end"),
                    ),
                ).alias("out"),
            ),
            lambda a: a["out"],
        )

    def whole(x: Column) -> Column:
        n = F.size(x)
        step = F.ceil(F.sqrt(n)).cast("int")
        parts = F.transform(F.sequence(F.lit(1), n, step), lambda i: F.slice(x, i, step))
        return F.get(F.transform(F.array(parts), joined), F.lit(0))

    def joined(parts: Column) -> Column:
        begins = F.aggregate(
            parts,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, part: F.struct(
                F.aggregate(part, a["at"], lambda s, x: s + size(x)).alias("at"),
                F.array_append(a["out"], a["at"]).alias("out"),
            ),
            lambda a: a["out"],
        )
        return F.flatten(F.zip_with(parts, begins, walk))

    # an array of one value names it, so that it is worked out once
    once = F.transform(F.array(pairs), lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(F.array().cast(kind)))
    return F.get(once, F.lit(0))


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def part(a: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        return a + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), part) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.rlike(BYTE))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def found(text: Column, kind: str) -> Column:
    """The valid spans of one kind; an empty array without any, or for a null text."""
    none = F.array().cast("array<struct<value:string,start:int,end:int>>")
    hint = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(HINTS[kind])
    spans = F.filter(located(text, PATTERNS[kind]), lambda x: _valid(kind, x["value"]))
    return F.coalesce(F.when(hint, spans), none)


def _shown(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def _entities(kind: str, spans: Column) -> Column:
    # Spark would give a lambda's second parameter the place in the array
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), F.lower(x["value"])))


def terms_of(text: Column) -> Column:
    """The different terms of a text, in lower case; those within an email address are not its words."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    words = F.array_distinct(F.regexp_extract_all(bare, F.lit(TERM), F.lit(0)))
    return F.array_distinct(F.transform(words, F.lower))


def marked(text: Column, shares: Column) -> Column:
    """Every place of the terms that are keys of `shares`, as (start, end, share)."""
    pairs = F.zip_with(
        F.regexp_extract_all(text, F.lit(TERM), F.lit(0)),
        F.split(text, TERM, -1),
        lambda word, gap: F.struct(
            F.length(word).alias("length"),
            F.length(gap).alias("gap"),
            F.try_element_at(shares, F.lower(word)).alias("share"),
        ),
    )
    kind = "array<struct<start:int,end:int,share:double>>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), end.alias("end"), x["share"].alias("share"))
        # only what is marked copies the array
        more = F.when(x["share"].isNotNull(), F.array_append(a["out"], span)).otherwise(a["out"])
        return F.struct(end.alias("at"), more.alias("out"))

    return F.aggregate(
        F.filter(pairs, lambda x: x["length"].isNotNull()),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        step,
        lambda a: a["out"],
    )


def chance(hits: Column, tries: Column, rate: Column) -> Column:
    """An upper bound (Chernoff's) of the chance of `hits` or more among `tries` at this rate."""
    part = hits / tries
    rest = F.when(part < 1, (1 - part) * F.log((1 - part) / (1 - rate))).otherwise(0.0)
    return F.when(part <= rate, 1.0).otherwise(F.exp(-tries * (part * F.log(part / rate) + rest)))


def disclosing(texts: DataFrame, docs_terms: DataFrame, n_docs: int) -> DataFrame:
    """(entity, term, share): how much of an entity's information a term discloses.

    `texts` has a row for each entity and different text with it: (entity, copies,
    n_entity, n_texts, terms). share = PMI(entity; term) / IC(entity) with the chances
    that a document of the corpus has the entity, the term, or both: 1 if the term
    stands nowhere else. Only pairs that chance explains with at most LEVEL count; two
    different texts suffice for a rare term.
    """
    pairs = (
        texts.select("entity", "copies", "n_entity", "n_texts", F.explode("terms").alias("term"))
        .groupBy("entity", "n_entity", "n_texts", "term")
        .agg(F.count("*").alias("support"), F.sum("copies").alias("n_both"))
        .where(F.col("support") > 1)
    )
    n = F.lit(float(n_docs))
    return (
        pairs.join(docs_terms, "term")
        .where(chance(F.col("support"), F.col("n_texts"), F.col("n_term") / n) <= LEVEL)
        .select(
            "entity",
            "term",
            (
                F.log2(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
                / F.nullif(F.log2(n / F.col("n_entity")), F.lit(0.0))
            ).alias("share"),
        )
        .where(F.col("share") >= GENERALISE)
    )


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `pii`: an array of spans for each kind and `term`.

    Kinds are the base patterns' valid matches; `term` has every place of the words that
    disclose a protected value in a document with that value, wherever they stand in it, with
    the share they disclose. Rows are told apart by doc_id and text hash, so equal rows get
    equal results; a null doc_id is an id like any other and a null text has no spans. An
    empty table gives no rows. A column `pii` of `docs` is replaced.

    Patterns are evaluated within each row. Co-occurrence moves the different words of
    documents with values, those of values in one text only no further, and one count for each
    term and task of the corpus; values that very many documents share are
    pre-aggregated, and no group of theirs is gathered.
    """
    columns = [c for c in docs.columns if c != "pii"]
    own = [F.col(f"`{c}`") for c in columns]
    own_id, own_hash, shares_ = free(docs, "_own_id", "_own_hash", "_shares")
    kept = dict(zip(KINDS, free(docs, *[f"_{k}" for k in KINDS]), strict=True))
    keys = ["_id", "_hash"]
    raw = F.col(f"`{text}`")
    ids = [F.col("doc_id").alias("_id"), F.xxhash64(raw).alias("_hash")]
    spans = {k: found(raw, k) for k in KINDS}

    values = F.array_distinct(F.concat(*[_entities(k, s) for k, s in spans.items()]))
    bearing = written(
        # a generator, as a filter would evaluate the patterns twice
        docs.select(*ids, raw.alias("_text"), F.explode(F.filter(F.array(values), lambda v: F.size(v) > 0)).alias("values"))
        .select(*keys, "values", terms_of(F.col("_text")).alias("terms")),
        "bearing",
    )
    places = (
        bearing.select("_hash", F.explode("values").alias("entity"))
        .groupBy("entity", "_hash")
        .agg(F.count("*").alias("copies"))
    )
    entities = (
        places.groupBy("entity")
        .agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_texts"))
        .where(F.col("n_texts") > 1)
    )
    shared = written(places.join(entities, "entity"), "shared")
    # copies of one text meet as one row of each task before they are joined
    different = bearing.groupBy("_hash").agg(F.first("terms").alias("terms"))
    texts = written(
        different.join(shared.select("_hash").distinct(), "_hash", "left_semi"), "texts"
    ).join(shared, "_hash")
    terms = (
        docs.select(F.explode(terms_of(raw)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n_term"))
    )
    shares = disclosing(texts, terms, docs.count())
    of_text = (
        texts.select("_hash", "entity", F.explode("terms").alias("term"))
        .join(shares, ["entity", "term"])
        .groupBy("_hash", "term")
        .agg(F.max("share").alias("share"))
        .groupBy("_hash")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias(shares_))
    )
    per = (
        bearing.select(*keys)
        .distinct()
        .join(of_text, "_hash")
        .select(F.col("_id").alias(own_id), F.col("_hash").alias(own_hash), shares_)
    )
    none = F.array().cast("array<struct<start:int,end:int,share:double>>")
    base = docs.select(*own, *[s.alias(kept[k]) for k, s in spans.items()])
    match = F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.xxhash64(raw) == F.col(own_hash))
    inside = lambda t: F.exists(
        F.concat(*[F.col(kept[k]) for k in KINDS]),
        lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]),
    )
    places_of = F.when(F.col(shares_).isNotNull(), marked(raw, F.col(shares_))).otherwise(none)
    return base.join(per, match, "left").select(
        *own,
        F.struct(
            *[F.col(kept[k]).alias(k) for k in KINDS],
            # the values themselves are spans already
            F.filter(places_of, lambda t: ~inside(t)).alias("term"),
        ).alias("pii"),
    )


def shown(pii: str = "pii", kinds: tuple[str, ...] = (*KINDS, "term")) -> Column:
    """kind:start:end of all spans, by kind, then start, joined by commas."""
    return F.array_join(F.concat(*[_shown(k, F.col(f"{pii}.{k}")) for k in kinds]), ",")


def _replaced(spans: Column, by: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            s["start"].alias("start"), (-s["end"]).alias("back"), F.lit(by).alias("by")
        ),
    )


def sanitised(text: Column, pii: str = "pii") -> Column:
    """The text with values replaced by their kind, terms by [WORD] or by nothing.

    Of spans that overlap the one that starts first is replaced; of those the longest.
    """
    marks = F.concat(
        *[
            _replaced(F.col(f"{pii}.{k}"), f"[{k.upper()}]") for k in KINDS
        ],
        F.transform(
            F.col(f"{pii}.term"),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["end"]).alias("back"),
                F.when(s["share"] >= REMOVE, "").otherwise("[WORD]").alias("by"),
            ),
        ),
    )
    return F.aggregate(
        F.array_sort(marks),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, m: F.when(m["start"] < a["at"], a).otherwise(
            F.struct(
                (-m["back"]).alias("at"),
                F.concat(
                    a["out"], F.substring(text, a["at"] + 1, m["start"] - a["at"]), m["by"]
                ).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
