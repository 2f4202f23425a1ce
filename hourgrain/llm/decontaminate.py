"""Benchmark decontamination by template windows, with built-in DataFrame functions only.

A text becomes a sequence of template words: numbers, names (a capital that no sentence start explains) and units are
replaced by typed placeholders, everything else is lower-cased, punctuation goes. Windows of ``window`` template words are
joined by hash with those of the benchmark items, then compared word by word. Over all matched windows of one alignment (a
document, an item and the distance between their places) the item's slot values must map one to one to the document's, so
"a train covers 60 miles in 2 hours" is found as "a train covers 90 miles in 3 hours", while a coincidence of placeholders
is not; a window whose slots have the item's own values is evidence without that. Windows with fewer than ``concrete`` words
that are no placeholders only take part in the check of slots and are no evidence.

In a second variant of the template, capitals that open a sentence are names too, and further number words and ordinals are
numbers; windows meet in either variant of either side, and each pair of variants has its own alignments. Windows of bare
lower-cased words that are equal are verbatim evidence, whatever their capitals and however few of them are concrete. The figures of a document
and an item come from the first variant (which is what the SQL states) if it has evidence, else from the others.

A text can only match where all pairs of neighbouring words of a window are pairs of items or hold what may be a placeholder, with
the longest concrete word of an item's window among them; if the items' pairs are few enough to be a literal list, other texts are left out at once.
The first pass explodes only window hashes; documents without a hit never carry their text any further. Item windows are
broadcast when their counted rows are few enough, otherwise both sides are shuffled.

Defined results: null and empty texts, and texts or items with fewer words than the window, match nothing; rows that share an
id are one document; a null id is reported as null; repeated items are one item; an empty table gives an empty result; only the
named columns are read. Texts are matched whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrain.llm.common import cut_lineage, hinted

#: A number, or a word with inner apostrophes or hyphens; trailing sentence ends stay with it.
BARE = r"(?:\p{N}+(?:[.,:/]\p{N}+)*|\p{L}[\p{L}\p{N}]*(?:['’-][\p{L}\p{N}]+)*)"
WORD = BARE + "[.!?]*"
#: Distinct pairs of neighbouring words of items up to which they are a literal list.
LISTED = 50_000
NUMBER_WORDS = "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen twenty thirty forty fifty hundred thousand million billion".split()
#: Further number words, which are placeholders in the second variant only.
_TENS, _ONES = "twenty thirty forty fifty sixty seventy eighty ninety".split(), "one two three four five six seven eight nine".split()
_FIRST = "first second third fourth fifth sixth seventh eighth ninth".split()
MORE_NUMBER_WORDS = (
    [*"one sixteen seventeen eighteen nineteen sixty seventy eighty ninety trillion".split(), *_FIRST]
    + "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth hundredth thousandth millionth billionth".split()
    + [f"{x[:-1]}ieth" for x in _TENS] + [f"{x}-{y}" for x in _TENS for y in _ONES + _FIRST]
)
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre litres gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees watt watts volt volts joule joules mph kmh"
).split()

#: The forms in which windows are compared: the two template variants and the bare words.
FORMS = ("t", "u", "w")


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(pattern), F.lit(0))


def with_slots(texts: DataFrame) -> DataFrame:
    """``text`` replaced by ``slots``, an array of (t, u: template words of the two variants, w: bare word).

    Each step is a column of its own, so that no expression repeats the work of an earlier one.
    """
    bare = texts.withColumn("tokens", words(F.col("text"))).drop("text").withColumn("bare", F.transform("tokens", lambda x: F.lower(F.rtrim(x, F.lit(".!?")))))

    def one(raw: Column, i: Column) -> Column:
        word, first = F.get("bare", i), F.substring(raw, 1, 1)
        opens = (i == 0) | F.right(F.get("tokens", i - 1), F.lit(1)).isin(".", "!", "?")
        kind = (
            F.when(first.between("0", "9") | word.isin(*NUMBER_WORDS), F.lit("<num>"))
            .when(word.isin(*UNITS), F.lit("<unit>"))
            .when(first != F.lower(first), F.when(opens, F.lit("<opens>")).otherwise(F.lit("<name>")))
        )
        return F.struct(kind.alias("k"), word.alias("w"))

    def slot(s: Column) -> Column:
        t = F.when(s["k"] == "<opens>", s["w"]).otherwise(F.coalesce(s["k"], s["w"]))
        u = F.when(s["w"].isin(*MORE_NUMBER_WORDS), F.lit("<num>")).when(s["k"] == "<opens>", F.lit("<name>")).otherwise(F.coalesce(s["k"], s["w"]))
        return F.struct(t.alias("t"), u.alias("u"), s["w"].alias("w"))

    kinds = bare.withColumn("kinds", F.transform("tokens", one)).drop("tokens", "bare")
    return kinds.withColumn("slots", F.transform("kinds", slot)).drop("kinds")


def with_windows(slots: DataFrame, window: int) -> DataFrame:
    """Adds ``hashes_t``, ``hashes_u`` and ``hashes_w`` of all windows of ``slots``, by doubling; empty if there are fewer words.

    Explode them with the outer forms: for the others the optimiser infers a filter on the array's size, pushes it
    below these steps, and so repeats them inside one expression.
    """
    names = {f: f"hashes_{f}" for f in FORMS}
    hashed = lambda f: lambda s: F.xxhash64(s[f])
    out = slots.withColumns({h: F.transform("slots", hashed(f)) for f, h in names.items()})

    def joined(df: DataFrame, by: int) -> DataFrame:
        n = F.greatest(F.size("hashes_w") - by, F.lit(0))
        return df.withColumns({h: F.zip_with(F.slice(h, F.lit(1), n), F.slice(h, F.lit(by + 1), n), lambda a, b: F.xxhash64(a, b)) for h in names.values()})

    size = 1
    while size * 2 <= window:
        out, size = joined(out, size), size * 2
    return joined(out, window - size) if window > size else out


def placed(slots: DataFrame, window: int) -> DataFrame:
    """A row for every window and form: place ``at``, ``form``, ``hash``, ``x`` (array of t: words in that form, w: bare words)."""
    each = F.arrays_zip(*(F.col(f"hashes_{f}") for f in FORMS))
    rows = with_windows(slots, window).withColumn("all", each).select(*(c for c in slots.columns if c != "slots"), "slots", F.posexplode_outer("all").alias("at", "h"))
    own = F.slice("slots", F.col("at") + 1, F.lit(window))
    seen_as = lambda f: lambda s: F.struct(s[f].alias("t"), s["w"].alias("w"))
    forms = F.array(*(F.struct(F.lit(f).alias("form"), F.col(f"h.hashes_{f}").alias("hash"), F.transform("own", seen_as(f)).alias("x")) for f in FORMS))
    rows = rows.where("h IS NOT NULL").withColumn("own", own).drop("slots")
    return rows.select(*(c for c in slots.columns if c != "slots"), "at", F.explode(forms).alias("f")).select(*(c for c in slots.columns if c != "slots"), "at", "f.form", "f.hash", "f.x")


def promising(texts: DataFrame, own: DataFrame, items: DataFrame, window: int) -> DataFrame:
    """The rows of ``texts`` that may share a solid window with ``own``, and perhaps others: all of them if the items have too many words.

    Each pair of neighbouring words gets a mark: "0" if no item has that pair and neither word may be a placeholder, "a" if one of them is the
    longest concrete word of a solid window, else "1". A window needs a run of pairs that are not "0", an "a" among them.
    """
    beside = F.zip_with("slots", F.slice("slots", F.lit(2), F.size("slots")), lambda a, b: F.concat_ws(" ", a["w"], b["w"]))
    pairs = [r["w"] for r in items.where("size(slots) > 1").select(F.explode(beside).alias("w")).distinct().limit(LISTED + 1).collect()]  # bounded by LISTED
    concrete = F.transform(F.filter("own", lambda s: s["t"] == s["w"]), lambda s: F.struct(F.length(s["w"]).alias("n"), s["w"].alias("w")))
    longest = own.where("solid").select(F.array_max(concrete)["w"].alias("w")).distinct()
    anchors = [r["w"] for r in longest.limit(LISTED + 1).collect()]
    if max(len(pairs), len(anchors)) > LISTED or window < 2 or None in anchors:  # none: a window without a concrete word
        return texts
    placeholders = {*NUMBER_WORDS, *MORE_NUMBER_WORDS, *UNITS}

    def mark(x: Column, y: Column) -> Column:
        maybe = lambda c: c.isin(*placeholders) | c.between("0", ":") | (F.lower(c) != c)
        met = F.concat_ws(" ", F.lower(x), F.lower(y)).isin("", *pairs) | maybe(x) | maybe(y)
        return F.when(met, F.when(F.lower(x).isin("", *anchors) | F.lower(y).isin("", *anchors), F.lit("a")).otherwise(F.lit("1"))).otherwise(F.lit("0"))

    # the words stand in an array of one, so that they are found once although they are used twice
    marks = F.transform(F.array(words(F.col("text"), BARE)), lambda t: F.array_join(F.zip_with(t, F.slice(t, F.lit(2), F.size(t)), mark), ""))
    return texts.where(F.get(marks, F.lit(0)).rlike(f"(?=[1a]{{{window - 1}}})[1a]{{0,{window - 2}}}a"))


def one_to_one(pairs: Column) -> Column:
    """Whether distinct (b, d) pairs map every b to one d and the reverse."""
    return (F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"]))) == F.size(pairs)) & (F.size(F.array_distinct(F.transform(pairs, lambda p: p["d"]))) == F.size(pairs))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 8, concrete: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item that share evidence: id, item, n_windows (matched windows of the item), first_word
    (place in the document of the first, from 0), reparameterised (some slot value differs)."""
    items = with_slots(benchmark.select(benchmark[item_col].alias("item"), benchmark[item_text_col].cast("string").alias("text")))
    own = placed(items, window).select("item", F.col("at").alias("item_at"), F.col("form").alias("item_form"), "hash", F.col("x").alias("own"))
    solid = F.size(F.filter("own", lambda s: s["t"] == s["w"])) >= F.when(F.col("item_form") == "w", 0).otherwise(concrete)
    own = cut_lineage(own.withColumn("solid", solid).distinct())

    keys = own.where("solid").select("hash").distinct()
    rows = own.count()
    texts = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].cast("string").alias("text"))
    every = F.array_distinct(F.concat(*(F.col(f"hashes_{f}") for f in FORMS)))
    hashed = with_windows(with_slots(promising(texts, own, items, window)), window).select("id", F.explode_outer(every).alias("hash"))
    hit = cut_lineage(hashed.join(hinted(keys, rows), "hash", "left_semi").select("id").distinct())

    few = hinted(hit.select(F.col("id").alias("hit")), hit.count())
    found = placed(with_slots(texts.join(few, F.col("id").eqNullSafe(F.col("hit")), "left_semi")), window).withColumnRenamed("x", "theirs")
    met = found.join(hinted(own, rows), "hash").where(((F.col("form") == "w") == (F.col("item_form") == "w")) & (F.transform("own", lambda s: s["t"]) == F.transform("theirs", lambda s: s["t"])))
    pairs = F.array_distinct(F.filter(F.zip_with("own", "theirs", lambda a, b: F.when(a["t"] != a["w"], F.struct(a["w"].alias("b"), b["w"].alias("d")))), lambda p: p.isNotNull()))
    met = met.select("id", "item", "form", "item_form", "at", "item_at", pairs.alias("pairs"), "solid", (F.col("solid") & F.forall(pairs, lambda p: p["b"] == p["d"])).alias("verbatim"))
    aligned = met.groupBy("id", "item", "form", "item_form", (F.col("at") - F.col("item_at")).alias("shift")).agg(
        F.collect_set(F.when(F.col("solid"), F.col("item_at"))).alias("solid"), F.collect_set(F.when(F.col("verbatim"), F.col("item_at"))).alias("verbatim"),
        F.min(F.when(F.col("solid"), F.col("at"))).alias("first"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    ).withColumn("whole", one_to_one(F.col("pairs")))
    evidence = aligned.withColumn("windows", F.when(F.col("whole"), F.col("solid")).otherwise(F.col("verbatim"))).where(F.size("windows") > 0)
    plain = (F.col("form") == "t") & (F.col("item_form") == "t")
    out = evidence.groupBy("id", "item", plain.alias("plain")).agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("windows")))).cast("bigint").alias("n_windows"), F.min("first").cast("bigint").alias("first_word"),
        F.max(F.col("whole") & F.exists("pairs", lambda p: p["b"] != p["d"])).alias("reparameterised"),
    )
    out = out.groupBy("id", "item").agg(F.max_by(F.struct("n_windows", "first_word", "reparameterised"), "plain").alias("best"))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.*")
