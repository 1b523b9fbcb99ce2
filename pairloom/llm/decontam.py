"""Benchmark decontamination by template canonicalisation.

Method. Words become templates: numbers, names (capitalised words, wherever they stand, but for the OPENERS that
begin sentences) and units (after a number) turn into typed placeholders. Windows of WINDOW template words of every document are
hash-joined with those of the benchmark; windows without placeholders match literally. Literal
windows (lower case, no placeholders) are joined as well, so a change of case hides nothing. A
window with placeholders, MIN_LITERALS of whose words are literal, counts if on its
diagonal (document position less item position) each slot value of the item stands for one value of
the document and the reverse: a re-parameterised question keeps its numbers' and names' roles.
Windows of fewer literal words are decided by the run of consecutive windows that they stand in: it
counts if it has MIN_LITERALS literal words as a whole and its slot values stand for each other in the same way.

A (document, item) pair is contaminated if MIN_WINDOWS consecutive windows of the item (ten words), or all of
them if it has fewer, stand consecutively in the document. Such a run has a window at a multiple
of MIN_WINDOWS, so a first pass hashes those alone; documents it hits are then searched at every
place. Items shorter than WINDOW words match only documents of the same words.

Only built-in functions run; document windows meet the benchmark's by a broadcast join if the benchmark has
at most BROADCAST_WINDOWS windows (it is counted first), else by a shuffled one in which the rows of passages that many
documents hold are dealt into parts (common.hot_join).

Defined results. Null or empty texts, and texts without words, have no windows. Each row is judged by its own text: rows of
a null doc_id too, and rows that share a doc_id but not their text are not mixed. Rows of equal doc_id and item give one result,
the best of theirs. Items of a null item_id are left out. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

WINDOW, MIN_LITERALS, MIN_WINDOWS = 8, 5, 3
BROADCAST_WINDOWS = 500_000
UNITS = "g kg mg t oz lb lbs km m cm mm mi mile miles ft feet inch inches l ml hour hours minute minutes second seconds day days week weeks month months year years dollar dollars euro euros cent cents usd eur percent mph kmh kwh kw w v a".split()
# Words that are capitalised for their place in a sentence, and so no names.
OPENERS = """A An The This That These Those There Then Thus Here If In On At By For From Of To With Without After Before During Since Until While When
Where Which Who Whom Whose What Why How And But Or Nor So Yet Because Although Though As Is Are Was Were Be Been Do Does Did Has Have Had Can Could
May Might Must Shall Should Will Would Not No Yes All Any Both Each Either Every Few Many More Most Much Neither None Some Such One Two Three Four Five
Six Seven Eight Nine Ten First Second Third Last Next Now It Its He She They We You His Her Their Our Your My Let Suppose Assume Consider Given Find Show
Prove Compute Calculate Determine Evaluate Explain Write Use Solve Simplify Describe Choose Select Name List State Give Tell Say See Note However Therefore
Der Die Das Ein Eine El La Los Las Un Una Le Les Une Des Il Elle Es Er Sie Wir Ich Und Aber Wenn Et Ou Y""".split()
#: Placeholders; white space takes their place where a text has them itself.
NUMBER, NAME, UNIT = "\u0002", "\u0003", "\u0004"
WORD = rf"[\p{{L}}\p{{N}}\p{{M}}{NUMBER}{NAME}{UNIT}]++"
SLOTS = "array<struct<k:string,v:string>>"


def _plain(text: Column) -> Column:
    """A text whose numbers are one word each: digits joined by one . or , close up; 12kg becomes two words."""
    clean = F.translate(text, NUMBER + NAME + UNIT, "   ")
    return F.when(clean.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(clean, r"(?<=[0-9])[.,](?=[0-9])", ""), r"(?<=[0-9])(?=\p{L})", " ")).otherwise(clean)


def _template(plain: Column) -> Column:
    """The plain text with placeholders, word for word."""
    names = F.regexp_replace(plain, rf"(?<![\p{{L}}\p{{N}}\p{{M}}])(?=\p{{Lu}}\p{{Ll}})(?!(?:{'|'.join(OPENERS)})(?![\p{{L}}\p{{N}}\p{{M}}])){WORD}", NAME)
    numbers = F.regexp_replace(names, r"(?<![\p{L}\p{N}\p{M}])[0-9]++(?![\p{L}\p{N}\p{M}])", NUMBER)
    return F.regexp_replace(numbers, rf"(?<={NUMBER}\x20)(?i:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}\p{{M}}])", UNIT)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _slotted(template: Column) -> Column:
    return template.rlike(f"[{NUMBER}{NAME}]")


def windows(rows: DataFrame, key: str) -> DataFrame:
    """All windows of rows (key, text): key, n (literal windows of the text), pos (from 0), h, slots (null: a literal window),
    n_lit (literal words) and lead (the first word is literal)."""
    t = rows.select(key, _plain(F.col("text")).alias("plain")).withColumn("tpl", _template(F.col("plain")))
    w = t.select(key, _words(F.col("plain")).alias("lit"), F.when(_slotted(F.col("tpl")), _words(F.col("tpl"))).alias("tpl"))
    w = w.withColumn("n", F.greatest(F.size("lit") - WINDOW + 1, F.lit(1)))
    at = F.sequence(F.lit(1), F.col("n"))
    none = F.lit(None).cast(SLOTS)
    literal = F.transform(at, lambda i: F.struct((i - 1).alias("pos"), F.slice("lit", i, WINDOW).alias("w"), none.alias("slots")))

    def template(i):
        kinds, lits = F.slice("tpl", i, WINDOW), F.slice("lit", i, WINDOW)
        pairs = F.filter(F.zip_with(kinds, lits, lambda k, v: F.struct(k.alias("k"), v.alias("v"))), lambda s: s["k"].isin(NUMBER, NAME, UNIT))
        return F.struct((i - 1).alias("pos"), kinds.alias("w"), pairs.alias("slots"))

    held = F.filter(F.transform(at, template), lambda s: F.size(s["slots"]) > 0)
    both = F.when(F.size("lit") == 0, None).when(F.col("tpl").isNull(), literal).otherwise(F.concat(literal, held))
    x = w.select(key, "n", F.explode(both).alias("x"))
    return x.select(key, "n", "x.pos", _hash([F.get("x.w", F.lit(j)) for j in range(WINDOW)]).alias("h"), "x.slots", (F.size("x.w") - F.coalesce(F.size("x.slots"), F.lit(0))).alias("n_lit"), (~F.get("x.w", F.lit(0)).isin(NUMBER, NAME, UNIT)).alias("lead"))


def _hash(words: list[Column]) -> Column:
    """Of a window's words; those that a short text lacks are null and leave the hash as it is."""
    return F.xxhash64(*words)


def _spots(docs: DataFrame, stride: int) -> DataFrame:
    """doc, h: the windows of rows (doc, text) at multiples of stride, literal and template.

    A run of stride consecutive windows has one at such a place. All of it is generated code: the
    windows of a text are never held together.
    """
    t = docs.select("doc", _plain(F.col("text")).alias("plain")).withColumn("tpl", _template(F.col("plain")))
    ways = F.when(_slotted(F.col("tpl")), F.array("plain", "tpl")).otherwise(F.array("plain"))
    w = t.select("doc", F.explode(ways).alias("way")).select("doc", _words(F.col("way")).alias("w"))
    at = F.explode(F.when(F.size("w") > 0, F.sequence(F.lit(0), F.greatest(F.size("w") - WINDOW, F.lit(0)), F.lit(stride)))).alias("i")
    return w.select("doc", "w", at).select("doc", _hash([F.get("w", F.col("i") + j) for j in range(WINDOW)]).alias("h"))


def _sound(hits: DataFrame, by: list[str]) -> DataFrame:
    """The groups of hits with placeholders in which each slot value of the item stands for one of the document and the reverse."""
    pair = hits.select(*by, F.explode(F.arrays_zip("si", "sd")).alias("z")).select(*by, F.col("z.si.k").alias("k"), F.col("z.si.v").alias("vi"), F.col("z.sd.v").alias("vd")).distinct()
    return pair.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("k", "vi").alias("ni"), F.count_distinct("k", "vd").alias("nd")).where("n = ni and n = nd").select(*by)


def text_key() -> list[Column]:
    """What a text is known by: two independent 64-bit digests and its length."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.length("text").alias("size")]


def clean(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of docs whose text holds no passage of the benchmark, whatever their other columns; null texts stay."""
    names = [f"__pairloom_{c}" for c in ("h1", "h2", "size")]
    with common.Scratch(docs.sparkSession) as tmp:
        found = _found(docs.select(F.lit(0).alias("doc_id"), "text"), benchmark, tmp, broadcast_windows)
        leaks = common.written(found.select("doc.h1", "doc.h2", "doc.size").distinct().toDF(*names), "leaks")
    return docs.withColumns(dict(zip(names, text_key()))).join(leaks, names, "left_anti").select(*docs.columns)


def contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """Pairs: doc_id, item_id, n_windows (of the item, found in the document), n_literal, coverage (share of the item's windows)."""
    with common.Scratch(docs.sparkSession) as tmp:
        found = _found(docs, benchmark, tmp, broadcast_windows)
        best = found.groupBy("doc.doc_id", "item_id").agg(F.max(F.struct("n_windows", "n_literal", "coverage")).alias("x"))
        return common.written(best.select("doc_id", "item_id", "x.*"), "contaminated")


def _found(docs: DataFrame, benchmark: DataFrame, tmp: common.Scratch, broadcast_windows: int) -> DataFrame:
    """The pairs with doc, the row's doc_id and text_key(), in place of doc_id."""
    docs = docs.where("text is not null").select(F.struct("doc_id", *text_key()).alias("doc"), "text")
    index = tmp.written(windows(benchmark.where("item_id is not null").select("item_id", "text"), "item_id"), "bench")
    size = index.agg(F.count("*").alias("n"), F.coalesce(F.min("n"), F.lit(1)).alias("least")).first()
    keys = index.select("h").distinct()
    index = index.select("item_id", "h", F.col("pos").alias("pi"), F.col("slots").alias("si"), F.col("n").alias("n_item"), "n_lit", "lead")
    small, stride = size["n"] <= broadcast_windows, min(MIN_WINDOWS, size["least"])
    spots = _spots(docs, stride)
    hit = spots.join(F.broadcast(keys), "h", "left_semi") if small else common.hot_join(tmp.written(spots, "spots"), keys, ["h"], "doc")
    some = tmp.written(hit.select("doc").distinct(), "suspects")
    tmp.drop("spots")
    own = docs.join(some.withColumnRenamed("doc", "own"), F.col("doc").eqNullSafe(F.col("own")), "left_semi")
    all_of = windows(own, "doc").select("doc", "h", F.col("pos").alias("pd"), F.col("slots").alias("sd"))
    found = all_of.join(F.broadcast(index), "h") if small else common.hot_join(tmp.written(all_of, "windows"), index, ["h"], "doc")
    found = found.where(F.col("sd").isNull() == F.col("si").isNull()).select("doc", "item_id", "n_item", "pi", (F.col("pd") - F.col("pi")).alias("diagonal"), F.col("sd").isNull().alias("literal"), "n_lit", "lead", "si", "sd")
    hits = tmp.written(found.distinct(), "hits")
    tmp.drop("windows")
    line = ["doc", "item_id", "diagonal"]
    dense = ~F.col("literal") & (F.col("n_lit") < MIN_LITERALS)
    slotted = hits.where(~F.col("literal") & ~dense)
    kept = hits.where("literal").unionByName(slotted.join(_sound(slotted, line), line, "left_semi")).select(*line, "n_item", "pi", "literal", F.lit(False).alias("proven"))
    # runs with dense windows are decided as a whole: their words are the first ones of their windows and the rest of the last window
    need = F.least(F.lit(MIN_WINDOWS), F.col("n_item"))
    runs = hits.withColumn("first", F.col("pi") - F.dense_rank().over(W.partitionBy(*line).orderBy("pi")))
    own = [*line, "first"]
    spots = runs.groupBy(*own, "n_item", "pi").agg(F.max(F.col("lead").cast("int")).alias("lead"), F.max("n_lit").alias("n_lit"), F.max(dense).alias("dense"))
    whole = spots.groupBy(*own, "n_item").agg(F.count("*").alias("n"), (F.sum("lead") + F.max_by(F.col("n_lit") - F.col("lead"), "pi")).alias("n_lit"), F.max("dense").alias("dense"))
    good = whole.where(F.col("dense") & (F.col("n") >= need) & (F.col("n_lit") >= MIN_LITERALS)).select(*own)
    runs = runs.join(good, own, "left_semi")
    runs = runs.join(_sound(runs.where("not literal"), own), own, "left_semi")
    kept = kept.unionByName(runs.select(*line, "n_item", "pi", "literal", F.lit(True).alias("proven")))
    # a diagonal holds at most the item's windows
    lines = kept.groupBy(*line, "n_item").agg(F.sort_array(F.collect_set("pi")).alias("all"), F.collect_set(F.when(F.col("literal"), F.col("pi"))).alias("plain"), F.max("proven").alias("proven"))
    run = F.exists("all", lambda x: F.size(F.filter("all", lambda y: y.between(x, x + need - 1))) == need)
    lines = lines.withColumn("run", F.col("proven") | run)
    total = lines.groupBy("doc", "item_id", "n_item").agg(F.max("run").alias("run"), F.size(F.array_distinct(F.flatten(F.collect_set("all")))).cast("long").alias("n_windows"), F.size(F.array_distinct(F.flatten(F.collect_set("plain")))).cast("long").alias("n_literal"))
    return total.where("run").select("doc", "item_id", "n_windows", "n_literal", F.round(F.col("n_windows") / F.col("n_item"), 4).alias("coverage"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: contaminated (document, item) pairs over all documents; clean documents have no row."""
    return contaminated(common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark"))
