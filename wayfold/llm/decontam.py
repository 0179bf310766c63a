"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, slot consistency; word-for-word windows
by the same join.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import bounded, materialise

#: Tokens of a window, and how many of them must be plain words for the window to say anything.
WINDOW, LITERALS = 10, 6
#: Benchmark windows are broadcast up to this many (16 bytes each in a hash table); beyond it, the join is shuffled.
BROADCAST_WINDOWS = 1_000_000
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "ms", "s", "min", "h", "ml", "l", "kb", "mb", "gb", "hz", "khz", "mhz", "w", "kw", "kwh",
    "v", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "seconds",
    "minutes", "hours", "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent", "liters", "litres", "degrees",
)
# Starts a slot; stands for a point inside a number. What separates tokens: ASCII and Latin-1 marks, general and
# ideographic punctuation.
_MARK, _POINT = "\u0001", "\u0002"
_BETWEEN = r"\x00\x03-\x2F\x3A-\x40\x5B-\x60\x7B-\xBF\u2000-\u206F\u3000-\u303F"


def marked(text: Column) -> Column:
    """The text as lower-case tokens with one space around each. A slot keeps its value behind a type mark: `n` name (a
    capitalised word, wherever it stands), `d` number, `u` unit after a number. Null is empty."""
    # Every pattern starts with the character it looks for; what stands before is looked at only there.
    out = F.translate(F.coalesce(text, F.lit("")), _MARK + _POINT, "  ")
    out = F.regexp_replace(out, rf"\p{{Lu}}(?<=(?:^|[{_BETWEEN}])\p{{Lu}})\p{{Ll}}+", _MARK + "n$0")
    out = F.regexp_replace(out, r"[.,:](?<=[0-9][.,:])(?=[0-9])", _POINT)
    out = F.regexp_replace(F.lower(out), f"[{_BETWEEN}]+", " ")
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    out = F.regexp_replace(out, f"[0-9](?<= [0-9])[0-9{_POINT}]*(?= )", _MARK + "d$0")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    return F.regexp_replace(out, f"({_MARK}d[0-9{_POINT}]+ )({units})(?= )", f"$1{_MARK}u$2")


def template(tokens: Column) -> Column:
    """Tokens with the slots' values left out."""
    cut = F.regexp_replace(tokens, rf"{_MARK}([ndu])[^ ]*", _MARK + "$1")
    return F.when(F.instr(tokens, _MARK) > 0, cut).otherwise(tokens)


def plain(tokens: Column) -> Column:
    """Tokens with the type marks left out: the lower-case words themselves."""
    return F.regexp_replace(tokens, f"{_MARK}[ndu]", "")


def _split(tokens: Column) -> Column:
    """Token array; an empty text is one empty token, too short for any window that counts."""
    return F.split(F.trim(tokens), " ")


def _token_hashes(words: Column) -> Column:
    return F.transform(words, lambda t: F.xxhash64(t))


def _windows(words: Column, size: int) -> Column:
    """Hashes of all windows of `size` template tokens, made from the tokens' hashes. That array is bound once, as the one item of an
    outer array, not evaluated again in each step."""
    def hashes(words: Column) -> Column:
        last = F.size(words) - size
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(words, i + 1, size)))

    return F.flatten(F.transform(F.array(_token_hashes(_split(words))), hashes))


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`(kind, size, hash, item_id, item_at, item_words, item_marked)`. Of every item all windows of words, kind 2 x size + 1;
    an item of fewer than `window` tokens is one window of its own length. Besides, kind 2 x size, the windows of its template
    with one slot or more, at most `window - LITERALS`, and at least LITERALS words (without slots, both are the same)."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), marked(F.col(text_col)).alias("tokens"))
    items = items.where(F.trim("tokens") != "").withColumn("plain", plain(F.col("tokens")))
    form = lambda verbatim, words, marked: F.struct(F.lit(verbatim).alias("verbatim"), words.alias("words"), marked.alias("marked"))
    forms = [form(0, template(F.col("tokens")), F.col("tokens")), form(1, F.col("plain"), F.col("plain"))]
    items = items.select("item_id", F.explode(F.array(*forms)).alias("f")).select("item_id", "f.verbatim", _split("f.marked").alias("item_marked"), _split("f.words").alias("item_words"))
    items = items.withColumn("size", F.least(F.lit(window), F.size("item_words"))).withColumn("kind", 2 * F.col("size") + F.col("verbatim"))
    rows = items.withColumn("item_at", F.explode(F.sequence(F.lit(0), F.size("item_words") - F.col("size"))))
    piece = F.slice("item_words", F.col("item_at") + 1, F.col("size"))
    slots = F.size(F.filter(piece, lambda t: t.startswith(_MARK)))
    says = (slots > 0) & (slots <= window - LITERALS) & (F.col("size") - slots >= min(LITERALS, window))
    rows = rows.withColumn("hash", F.xxhash64(_token_hashes(piece))).where((F.col("verbatim") == 1) | says)
    return rows.select("kind", "size", "hash", "item_id", "item_at", "item_words", "item_marked")


def _one_to_one(slots: Column) -> Column:
    """Each item value of the distinct pairs stands for one document value and the reverse, within a slot type."""
    values = F.transform(slots, lambda x: x.item_marked), F.transform(slots, lambda x: x.marked)
    return (F.size(F.array_distinct(values[0])) == F.size(slots)) & (F.size(F.array_distinct(values[1])) == F.size(slots))


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, per_window: bool = False
) -> DataFrame:
    """`(doc_id, item_id, shift, n_windows, n_slots, changed, consistent)`: a row for every alignment of a document with an item
    that shares a window of words or of the template. `changed`: a slot has another value than in the item. `consistent`: over all shared
    windows of the alignment each item value stands for one document value and the reverse, within a slot type.

    `per_window`: each window is judged by its own slots, so that more shared text never takes a match away and a window with
    the item's own values always counts; the counts and `changed` are those of the windows that pass, `consistent`: one does.

    Null ids of documents are left out, null texts are empty; repeated rows count once; extra columns are ignored."""
    marks = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = marks.where("doc_id is not null")
    marks = marks.select("doc_id", F.xxhash64("text").alias("row"), "text")
    known = materialise(benchmark_windows(benchmark, window=window))
    kinds = [r["kind"] for r in known.select("kind").distinct().orderBy("kind").collect()]  # at most 2 x `window` values
    keys = known.select("hash").distinct()
    small = known.count() <= BROADCAST_WINDOWS
    # Each step is a column of its own, so that no expression is worked out again where it is used more than once.
    texts = marks.withColumn("tokens", marked(F.col("text"))).withColumn("words", template(F.col("tokens"))).withColumn("plain", plain(F.col("tokens")))
    found = None
    if kinds:
        lists = F.array(*[_windows(F.col("plain" if k % 2 else "words"), k // 2) for k in kinds])
        rows = texts.select("doc_id", "row", F.posexplode(lists).alias("k", "hashes")).select("doc_id", "row", "k", F.posexplode("hashes").alias("at", "hash"))
        found = rows.join(F.broadcast(keys) if small else keys, "hash")
        found = found.select("doc_id", "row", F.element_at(F.array(*map(F.lit, kinds)), F.col("k") + 1).alias("kind"), "at", "hash")
    if found is None:
        empty = "doc_id long, item_id long, shift int, n_windows long, n_slots long, changed boolean, consistent boolean"
        return docs.sparkSession.createDataFrame([], empty)
    found = materialise(found.distinct())
    hit = bounded(found.select("doc_id", "row").distinct())
    tokens = marks.join(hit, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    tokens = tokens.select("doc_id", "row", marked(F.col("text")).alias("tokens"))
    tokens = tokens.select(
        "doc_id", "row", _split("tokens").alias("marked"), _split(template(F.col("tokens"))).alias("words"), _split(plain(F.col("tokens"))).alias("plain")
    )
    # The windows' own tokens, one short array per hit, before the items are joined: a document is read once.
    verbatim, size = F.col("kind") % 2 == 1, F.floor(F.col("kind") / 2).cast("int")
    piece = lambda name: F.when(verbatim, F.slice("plain", F.col("at") + 1, size)).otherwise(F.slice(name, F.col("at") + 1, size))
    pieces = found.join(tokens, ["doc_id", "row"]).select(
        "doc_id", "row", "kind", "hash", "at", piece("words").alias("words"), piece("marked").alias("marked")
    )
    cut = known.select(
        "kind", "hash", "item_id", "item_at",
        F.slice("item_words", F.col("item_at") + 1, F.col("size")).alias("item_words"),
        F.slice("item_marked", F.col("item_at") + 1, F.col("size")).alias("item_marked"),
    )
    pairs = pieces.join(F.broadcast(cut) if small else cut, ["kind", "hash"]).where("words = item_words")
    pairs = pairs.withColumn("shift", F.col("at") - F.col("item_at"))
    slots = F.filter(F.arrays_zip("item_marked", "marked"), lambda x: x.item_marked.startswith(_MARK))
    group = ["doc_id", "row", "item_id", "shift"]
    pairs = pairs.select(*group, "at", F.array_distinct(slots).alias("slots"))
    counts = _one_to_one(F.col("slots")) if per_window else F.lit(True)
    # One alignment is no longer than its item, so its slots fit in one row.
    one = pairs.withColumn("counts", counts).groupBy(*group).agg(
        F.size(F.collect_set(F.when(F.col("counts"), F.col("at")))).cast("long").alias("n_windows"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("counts"), F.col("slots"))))).alias("slots"),
    )
    return one.select(
        "doc_id", "item_id", "shift", "n_windows", F.size("slots").cast("long").alias("n_slots"),
        F.exists("slots", lambda x: x.item_marked != x.marked).alias("changed"),
        (F.col("n_windows") > 0 if per_window else _one_to_one(F.col("slots"))).alias("consistent"),
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, per_window: bool = False
) -> DataFrame:
    """`(doc_id, n_items, items, n_windows, reparameterised)`: one row per document that holds windows of an
    item: its own words, or its template with consistent slots; `items` lists the item ids in order. `reparameterised`: only with other slot values.
    Without `per_window` one inconsistent slot rejects a whole alignment, its word-for-word windows included (see `matches`)."""
    good = matches(docs, benchmark, id_col, text_col, window, per_window).where("consistent")
    per = good.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n"), F.min("changed").alias("changed"))
    return per.groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")).cast("array<string>"), ",").alias("items"),
        F.sum("n").alias("n_windows"), F.min("changed").alias("reparameterised"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_window: bool = False) -> DataFrame:
    """`docs` without the contaminated ones. Rows with a null id stay."""
    bad = bounded(contaminated(docs, benchmark, id_col, text_col, per_window=per_window).select(F.col("doc_id").alias(id_col)))
    return docs.join(bad, id_col, "left_anti")
