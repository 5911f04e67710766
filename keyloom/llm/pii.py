"""Personal data by pattern, and terms that give a protected entity away by co-occurrence.

The base spans are e-mail and IP addresses, card and phone numbers. On top of
them, sanitisation is information-theoretic, over all words of the corpus. The
context of a value is the run of at most ``CONTEXT`` words and values of its line
in which it stands. With N words, n_e of them in contexts of the value e, n_t that
are the term t and n_te that are both, a value has IC(e) = log(N / n_e) of
information to protect and t reveals PMI(t; e) = log(N n_te / (n_t n_e)) of it.
Every value and pair counts. The share n_te / n_t behind the PMI is drawn towards
n_e / N by one observation, and weighs as much as the different contexts that hold
the pair, so that copies are no evidence.

A term whose share PMI / IC reaches the threshold of its category (``DISCLOSURE``)
is a span of its own wherever it stands in a document with that value. It is
generalised to its category, or removed where the share reaches ``REMOVE``.
Everything is SQL expressions; those that name lambda variables are written as
text, which Spark reads much faster than calls that build them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bound, cut, rekey, scratch, small

#: Least share of a value's information that a term must reveal, by the category of the word as it stands there.
DISCLOSURE = {"NUMBER": 0.9, "NAME": 0.9, "TERM": 0.9}
#: From this share on nothing is left of a term, not even its category.
REMOVE = 0.98
#: Words and values of one context.
CONTEXT = 64
KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Runs are possessive and start where a run starts or the last match ended; this finds
#: the same matches as the plain greedy forms without trying every start inside a long run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_TERM = r"[\p{L}\p{M}\p{N}]++"
#: Private characters that enclose a value in a context; texts lose them before.
_OPEN, _CLOSE = "\ue000", "\ue001"
#: Code points of a piece of text that is cut by place.
_PIECE = 1024


def _running(numbers: str, step: str) -> str:
    """SQL of the running result of ``step``, an associative function of {a} and {b} with neutral 0, over the array<int> named ``numbers``.

    By blocks of about the root of the length, since an array that grows by one
    element a step is copied at each: the cost is the power 1.5 of the length.
    """
    ints = "cast(array() AS array<int>)"
    one = step.format(a="acc.at", b="n")
    scan = lambda of: f"aggregate({of}, named_struct('at', 0, 'out', {ints}), (acc, n) -> named_struct('at', {one}, 'out', concat(acc.out, array({one}))), acc -> acc.out)"
    blocks = f"transform(sequence(0, CAST(ceil(size({numbers}) / width) AS INT) - 1), i -> {scan(f'slice({numbers}, i * width + 1, width)')})"
    joined = f"flatten(transform(parts, (part, i) -> transform(part, n -> {step.format(a='IF(i > 0, get(totals, i - 1), 0)', b='n')})))"
    totals = scan("transform(parts, part -> element_at(part, -1))")
    some = bound(f"CAST(ceil(sqrt(size({numbers}))) AS INT)", "width", bound(blocks, "parts", bound(totals, "totals", joined)))
    return f"IF(size({numbers}) > 0, {some}, {ints})"


def _parts(text: str, pattern: str) -> str:
    """SQL of array<struct<0: text before a match, 1: the match>>; the last has the rest and a null."""
    return f"arrays_zip(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0))"


def located(text: str, pattern: str) -> str:
    """SQL of array<struct<start, end, value>> of the matches, in code points: lengths of the parts between matches add up."""
    lengths = "transform(found, x -> length(x.`0`) + length(x.`1`))"
    spans = "zip_with(found, ends, (x, e) -> named_struct('start', e - length(x.`1`), 'end', e, 'value', x.`1`))"
    return bound(f"filter({_parts(text, pattern)}, x -> x.`1` IS NOT NULL)", "found", bound(lengths, "lengths", bound(_running("lengths", "{a} + {b}"), "ends", spans)))


def _valid(kind: str, value: str) -> str:
    """SQL of whether a match of the pattern is a value."""
    if kind == "ip":
        return f"forall(split({value}, r'\\.'), p -> length(regexp_replace(p, '^0+(?=.)', '')) BETWEEN 1 AND 3 AND try_cast(p AS decimal(38,0)) <= 255)"
    if kind == "card":
        digit = "CAST(substring(d, length(d) - k + 1, 1) AS INT)"  # the k-th from the right
        luhn = f"aggregate(sequence(1, length(d)), 0, (a, k) -> a + CASE WHEN k % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) % 10 = 0"
        return bound(f"regexp_replace({value}, '[ -]', '')", "d", f"IF(length(d) BETWEEN 16 AND 19, {luhn}, false)")
    if kind == "phone":
        return f"length(regexp_replace({value}, '[^0-9]', '')) BETWEEN 8 AND 15"
    return "true"


def _gate(kind: str, text: str) -> str:
    """SQL of a cheap condition that every text with a match of the kind meets."""
    return {
        "email": f"contains({text}, '@')",
        "ip": f"({text} RLIKE r'[0-9]\\.[0-9]')",
        "card": f"({text} RLIKE r'[0-9](?:[\\x20-]?[0-9]){{15}}')",
        "phone": f"contains({text}, '+')",
    }[kind]


def _any_gate(text: str) -> Column:
    return F.coalesce(F.expr(" OR ".join(_gate(k, text) for k in KINDS)), F.lit(False))


def base_spans(text: str, kind: str) -> Column:
    """The valid spans of one kind in a column; empty for a null text."""
    spans = f"filter({located(text, PATTERNS[kind])}, m -> {_valid(kind, 'm.value')})"
    return F.expr(f"IF({_gate(kind, text)}, {spans}, cast(array() AS array<struct<start:int,end:int,value:string>>))")


def _each_replaced(rows: DataFrame, name: str, fill: Callable[[str, str], str]) -> DataFrame:
    """``rows`` with the values of one kind after the other replaced in column ``name``; ``fill`` gives SQL from a kind and a value."""
    for k in KINDS:
        put = f"concat(x.`0`, CASE WHEN x.`1` IS NULL THEN '' WHEN {_valid(k, 'x.`1`')} THEN {fill(k, 'x.`1`')} ELSE x.`1` END)"
        made = f"IF({_gate(k, 'old')}, array_join(transform({_parts('old', PATTERNS[k])}, x -> {put}), ''), old)"
        rows = rows.withColumn(name, F.expr(bound(name, "old", made)))
    return rows


def _entity(kind: str, value: str) -> str:
    return f"concat('{kind}:', lower({value}))"


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TERM), F.lit(0))


def contexts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tokens) of lines that may hold a value, cut into contexts: words in lower case and enclosed values; and (words) of all other text.

    Values are taken out of a line kind by kind, in the order of ``KINDS``; words
    are what is left of it.
    """
    lines = docs.where(_any_gate("text")).select(F.explode(F.split("text", "\n")).alias("line"))
    plain = docs.where(~_any_gate("text")).select(_words("text").alias("words")).unionByName(lines.where(~_any_gate("line")).select(_words("line").alias("words")))
    marked = lines.where(_any_gate("line")).select(F.translate("line", _OPEN + _CLOSE, "  ").alias("line"))
    marked = _each_replaced(marked, "line", lambda k, v: f"concat('{_OPEN}', {_entity(k, v)}, '{_CLOSE}')")
    tokens = marked.select(F.regexp_extract_all(F.lower("line"), F.lit(f"{_OPEN}[^{_CLOSE}]*+{_CLOSE}|{_TERM}"), F.lit(0)).alias("tokens"))
    pieces = f"transform(sequence(0, greatest(CAST(ceil(size(tokens) / {CONTEXT}) AS INT) - 1, 0)), i -> slice(tokens, i * {CONTEXT} + 1, {CONTEXT}))"
    return tokens.select(F.explode(F.expr(pieces)).alias("tokens")), plain


def disclosing_terms(docs: DataFrame, disclosure: float | None = None) -> DataFrame:
    """(entity, term, risk): terms that reveal at least ``disclosure`` of an entity's information.

    Counts are over all words of all texts; ``docs`` needs a column text.
    Without ``disclosure`` the least of ``DISCLOSURE`` holds.
    """
    least = min(DISCLOSURE.values()) if disclosure is None else disclosure
    with scratch(docs.sparkSession):
        found, plain = contexts(docs)
        found = cut(found.select(F.expr(f"filter(tokens, t -> startswith(t, '{_OPEN}'))").alias("values"), F.expr(f"filter(tokens, t -> NOT startswith(t, '{_OPEN}'))").alias("words")))
        seen = found.where(F.size("values") > 0).select(F.sort_array(F.array_distinct("values")).alias("values"), "words").groupBy("values", "words").agg(F.count("*").alias("n"))
        rows = cut(seen.select(F.explode("values").alias("value"), "words", "n")).withColumn("entity", F.translate("value", _OPEN + _CLOSE, ""))
        entity = cut(rows.groupBy("entity").agg(F.sum(F.size("words") * F.col("n")).alias("n_e")))
        times = rows.select("entity", F.explode(F.expr("transform(array_distinct(words), w -> named_struct('term', w, 'times', size(filter(words, v -> v = w))))")).alias("x"), "n")
        both = cut(times.groupBy("entity", F.col("x.term").alias("term")).agg(F.sum(F.col("x.times") * F.col("n")).alias("n_te"), F.count("*").alias("different")))
        # counted before the join: the words of the corpus grow faster than its vocabulary
        count = cut(plain.unionByName(found.select("words")).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n_t")))
        total = count.agg(F.coalesce(F.sum("n_t"), F.lit(0))).first()[0]
        prior = F.col("n_e") / F.lit(float(total))
        share = (F.col("different") * F.col("n_te") / F.col("n_t") + prior) / (F.col("different") + 1)
        known = both.join(small(entity.withColumnRenamed("entity", "of")), F.col("entity") == F.col("of")).join(count, F.col("term") == F.col("word"))
        risk = (F.log(share / prior) / -F.log(prior)).alias("risk")
        return cut(known.where(F.col("n_e") < total).select("entity", "term", risk).where(F.col("risk") >= least), keep=True)


def _row_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text), F.hash(text), F.length(text))


def _category(word: Column) -> Column:
    """NUMBER if a word has a digit, NAME if it begins with a capital letter, else TERM."""
    return F.when(word.rlike(r"\p{N}"), "NUMBER").when(word.rlike(r"^\p{Lu}"), "NAME").otherwise("TERM")


def term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, terms): per text that holds an entity, the spans array<struct<start, end, tag>> of the terms that disclose it.

    ``tag`` is the category in brackets, or empty for a term that is removed.
    """
    with scratch(docs.sparkSession):
        gated = docs.select("text").where(_any_gate("text")).select(_row_key(F.col("text")).alias("key"), "text")
        own = cut(_with_base(gated.groupBy("key").agg(F.first("text").alias("text"))).select("key", "text", _entities().alias("entities")))
        # blanks for values keep all other characters at their places
        blanked = _each_replaced(own.where(F.size("entities") > 0).select("key", "text"), "text", lambda k, v: f"repeat(' ', length({v}))")
        words = blanked.select("key", F.explode(F.expr(located("text", _TERM))).alias("m")).select("key", "m.start", "m.end", "m.value", F.lower("m.value").alias("word"))
        by_term = cut(terms.groupBy("term").agg(F.collect_list(F.struct("entity", "risk")).alias("of")))  # few values: each takes its share of the term's places
        placed = words.join(small(by_term), F.col("word") == F.col("term")).select("key", "start", "end", "value", "of")
        mine = own.select(F.struct(rekey(F.col("key.col1")).alias("col1"), "key.col2", "key.col3").alias("own"), "entities")
        risk = F.expr("array_max(transform(filter(of, e -> array_contains(entities, e.entity)), e -> e.risk))")
        risky = placed.join(mine, F.col("key") == F.col("own")).select("key", "start", "end", _category(F.col("value")).alias("category"), risk.alias("risk"))
        least = F.create_map(*(F.lit(x) for pair in DISCLOSURE.items() for x in pair))[F.col("category")]
        tag = F.when(F.col("risk") >= REMOVE, "").otherwise(F.concat(F.lit("["), "category", F.lit("]")))
        spans = risky.where(F.col("risk") >= least).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", tag.alias("tag")))).alias("terms"))
        return cut(spans, keep=True)


def _with_base(rows: DataFrame) -> DataFrame:
    return rows.select("*", *(base_spans("text", k).alias(f"_{k}") for k in KINDS))


def _entities() -> Column:
    return F.expr(f"array_distinct(concat({', '.join(f'transform(_{k}, m -> ' + _entity(k, 'm.value') + ')' for k in KINDS)}))")


def _joined(kind: str, name: str) -> Column:
    return F.expr(f"array_join(transform(_{kind}, m -> concat_ws(':', '{name}', m.start, m.end)), ',')")


def annotated(docs: DataFrame) -> DataFrame:
    """(row, text, _email, _ip, _card, _phone, _terms): the rows of ``docs`` as structs, with the spans of each kind in order of start.

    A null text has no spans. Whatever columns ``docs`` has stand inside ``row``, so no name clashes.
    """
    inside = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text"))
    terms = disclosing_terms(docs)
    out = _with_base(inside)
    none = F.array().cast("array<struct<start:int,end:int,tag:string>>")
    if terms.isEmpty():
        return out.withColumn("_terms", none)
    spans = small(term_spans(docs, terms).withColumnRenamed("key", "_at").withColumnRenamed("terms", "_terms"))
    joined = out.withColumn("_key", _row_key(F.col("text"))).join(spans, F.col("_key") == F.col("_at"), "left")
    return joined.select("row", "text", *(f"_{k}" for k in KINDS), F.coalesce("_terms", none).alias("_terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) for every row of ``docs``.

    Needs doc_id and text. ``spans`` lists ``kind:start:end``, base kinds first,
    then kind ``term``. Texts without spans give the digest of the empty string.
    Null ids and repeated rows are rows like others; an empty table gives none.
    Texts of any length are read whole.
    """
    rows = annotated(docs.select("doc_id", "text"))
    base = F.concat_ws(",", *(F.when(F.size(f"_{k}") > 0, _joined(k, k)) for k in KINDS))
    extra = F.when(F.size("_terms") > 0, _joined("terms", "term"))
    out = rows.select("row.doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS), base.alias("base"), extra.alias("extra"), F.size("_terms").cast("long").alias("n_term"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "extra").alias("spans"), "n_term")


def _filled(text: str, spans: str) -> str:
    """SQL of ``text`` with each of ``spans`` (in order of start) replaced by its tag; what an earlier span covers is gone.

    The text is read in pieces of ``_PIECE`` code points, since a place is found by counting from the front.
    """

    def between(a: str, b: str) -> str:
        part = f"substring(get(pieces, k), greatest({a} - k * {_PIECE}, 0) + 1, least({b} - k * {_PIECE}, {_PIECE}) - greatest({a} - k * {_PIECE}, 0))"
        return f"IF({b} > {a}, array_join(transform(sequence(CAST(floor({a} / {_PIECE}) AS INT), CAST(floor(({b} - 1) / {_PIECE}) AS INT)), k -> {part}), ''), '')"

    before = "IF(i > 0, get(ends, i - 1), 0)"
    one = f"concat({between(before, f'greatest({before}, s.start)')}, IF(s.end > {before}, s.tag, ''))"
    put = f"concat(array_join(transform(found, (s, i) -> {one}), ''), {between('element_at(ends, -1)', f'length({text})')})"
    ends = _running("stops", "greatest({a}, {b})")
    pieces = f"regexp_extract_all({text}, '(?s).{{1,{_PIECE}}}', 0)"
    return bound(spans, "found", bound(pieces, "pieces", bound("transform(found, s -> s.end)", "stops", bound(ends, "ends", put))))


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its texts replaced: values by their kind in brackets, terms by their category or by nothing.

    Where spans overlap, the one that starts first holds, and of those the
    longest; a later one only loses the part that is already replaced. Columns
    and rows are those of ``docs``; texts without spans stay as they are, null
    ones too.
    """
    rows = annotated(docs)
    tagged = ", ".join(f"transform(_{k}, m -> named_struct('start', m.start, 'neg', -m.end, 'tag', '[{k.upper()}]'))" for k in KINDS)
    every = f"array_sort(concat({tagged}, transform(_terms, m -> named_struct('start', m.start, 'neg', -m.end, 'tag', m.tag))))"
    spans = f"transform({every}, m -> named_struct('start', m.start, 'end', -m.neg, 'tag', m.tag))"
    any_span = " + ".join(f"size(_{k})" for k in (*KINDS, "terms"))
    text = F.expr(f"IF({any_span} > 0, {_filled('text', spans)}, text)")
    name = next(c for c in docs.columns if c.lower() == "text")
    return rows.select("row", text.alias("new")).select(*(F.col("new").alias(c) if c == name else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
