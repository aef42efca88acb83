"""URL filters: listed rules first, then association rules mined from labelled pages by FP-growth.

A page's items are its host labels' words, its path's words and query keys, all of them. Items that stand in the
same labelled pages are one class: no rule can tell them apart, and any of them stands for the class. FP-growth runs
on the classes of the pages to block, those labelled toxic or of low quality; an itemset's confidence is its count
there over its count in all labelled pages, found by the same inverted index as verdicts. A rule needs LEAST_COUNT
pages to block, a share SUPPORT of all labelled pages, CONFIDENCE, and to be surer than the pages' base rate. One that
has one item more than another and isn't surer is left out, which changes neither verdict nor confidence. Each rule is
indexed under its rarest class, and a page is looked up in that index by its classes and checked against the whole
rule. DataFrame operations only.

labels.doc_id is taken for the page_id of the page that it labels; labels of other things find nothing here. An id
labelled several times is to be blocked if any label says so. Null urls and urls without "://" have an empty host and
path and no rule fits them. Without labels, or without a rule that is sure enough, the method allows. Ties between
rules change nothing: one is enough. Repeated rows each give a row and count as pages of their own, an empty table
gives no rows, extra columns aren't read, and urls may be of any length.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import concluded, saved, table

#: (verdict, host, path): a rule fits its host and all subdomains where the path begins with its own (fixed values).
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
SUPPORT, LEAST_COUNT, CONFIDENCE = 0.002, 5, 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host between the first "://" and "/", "?", "#" or the end, A-Z lower-cased; the path from there up to "?", "#" or the end."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(rules: list[tuple[str, str, str]] = LISTED) -> Column:
    """The longest listed rule that fits columns host and path, as struct(size, rule, verdict), or null."""
    fits = []
    for verdict, host, path in rules:
        ok = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        fits.append(F.when(ok, F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def items(url: str = "url") -> Column:
    """The distinct items of a page."""
    text = F.coalesce(F.col(url), F.lit(""))
    words = F.filter(F.split(F.col("host"), r"[^a-z0-9]+"), lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
    path = F.filter(F.split(F.lower("path"), r"[^\p{L}]+"), lambda w: w != "")
    keys = F.regexp_extract_all(text, F.lit(r"[?&]([A-Za-z_]+)="), 1)
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("host="), w)), F.transform(path, lambda w: F.concat(F.lit("path="), w)), F.transform(keys, lambda w: F.concat(F.lit("key="), w))))


def met(baskets: DataFrame, index: DataFrame) -> DataFrame:
    """index' rows with the basket of each that holds all of ante; looked up under item, so a rule meets a basket once."""
    return baskets.withColumn("item", F.explode("classes")).join(index, "item").filter(F.size(F.array_except("ante", "classes")) == 0)


def mine(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST_COUNT) -> tuple[DataFrame, DataFrame]:
    """ante (classes), confidence and item (the rarest class) of the rules to block by, and the item and class of frequent items; pages has page_id and items."""
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").select(F.col("doc_id").alias("_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad")).groupBy("_id").agg(F.max("bad").alias("bad"))
    baskets = saved(pages.join(known, pages.page_id == known["_id"]).select("items", F.coalesce("bad", F.lit(False)).alias("bad"), F.monotonically_increasing_id().alias("basket")))
    n, n_bad = baskets.agg(F.count("*"), F.count_if("bad")).first()
    count = max(least, -int(-support * n // 1))
    # Items of the same baskets have the same number of them and the same sums of hashes.
    where = [F.count_if("bad").alias("c"), F.sum(F.xxhash64("basket").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit("basket"), "basket")).alias("x")]
    placed = baskets.select("basket", "bad", F.explode("items").alias("item")).groupBy("item").agg(*where).filter(F.col("c") >= count)
    classes = saved(placed.join(placed.groupBy("c", "s", "x").agg(F.min("item").alias("class")), ["c", "s", "x"]).select("item", "class", "c"))
    named = saved(baskets.select("basket", "bad", F.explode("items").alias("item")).join(classes, "item").groupBy("basket", "bad").agg(F.collect_set("class").alias("classes")))
    model = FPGrowth(itemsCol="classes", minSupport=min(1.0, (count - 0.5) / max(n_bad, 1))).fit(named.filter("bad").unionByName(baskets.filter("bad").select("basket", "bad", F.array().cast("array<string>").alias("classes")).join(named.select("basket"), "basket", "left_anti")))
    sets = model.freqItemsets.filter(F.col("freq") >= count).select(F.sort_array("items").alias("ante"), "freq")
    rarest = sets.withColumn("class", F.explode("ante")).join(classes.filter("item = class").select("class", "c"), "class").groupBy("ante", "freq").agg(F.min_by("class", F.struct("c", "class")).alias("item"))
    sure = met(named.select("basket", "classes"), rarest).groupBy("ante", "freq", "item").agg((F.col("freq") / F.count("*")).alias("confidence"))
    every = saved(sure.filter(F.col("confidence") >= confidence).filter(F.col("confidence") > n_bad / max(n, 1)).select("ante", "confidence", "item"))
    less = every.select("ante", "confidence", F.explode(F.transform("ante", lambda x: F.array_remove("ante", x))).alias("_less"))
    worse = less.join(every.select(F.col("ante").alias("_less"), F.col("confidence").alias("_sure")), "_less").filter(F.col("_sure") >= F.col("confidence")).select("ante").distinct()
    return saved(every.join(worse, "ante", "left_anti")), classes.select("item", "class")


@concluded
def url_verdicts(pages: DataFrame, labels: DataFrame, **limits: float) -> DataFrame:
    """page_id, host, path, rule (listed, else null), verdict, and confidence: of the surest mined rule that fits, else null."""
    host, path = host_and_path()
    parsed = pages.select("page_id", "url").withColumn("host", host).withColumn("path", path).withColumn("items", items()).withColumn("row", F.monotonically_increasing_id())
    parsed = saved(parsed)
    index, classes = mine(parsed, labels, **limits)
    named = parsed.select("row", F.explode("items").alias("item")).join(classes, "item").groupBy("row").agg(F.collect_set("class").alias("classes"))
    surest = met(named, index).groupBy("row").agg(F.max("confidence").alias("confidence"))
    judged = parsed.select("row", "page_id", "host", "path").join(surest, "row", "left").withColumn("_r", listed())
    return judged.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "confidence")


def op4_url_filters(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
