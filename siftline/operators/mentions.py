"""Names contained in texts: every text against every name, joined on each name's rarest word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPECIAL = r"([\\.\[\]{}()*+?^$|])"
#: A border lies between a word character and none, ASCII only; spelt out where the name's own character does not tell which it is in the text.
_BORDER = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Letters that are an ASCII letter in other case (long s, Kelvin); and dotless and dotted i, which Java takes for i and folding does not.
_ALIKE, _APART = "\u017f\u212a", "\u0131\u0130"


def mentioned(texts: DataFrame, names: DataFrame, text_id: str, text: str, name_id: str, name: str, least: int = 3) -> DataFrame:
    """(text_id, name_id, name) for every name of at least `least` characters that stands in a text between word borders, in either case, accented letters too.

    A text that contains a name has each of its words; the word that fewest texts
    have is joined on, and the whole name is then looked for.  Names without a word
    character are never found.
    """
    split = lambda c: F.array_remove(F.array_distinct(F.transform(F.split(c, "[^A-Za-z0-9_]+"), F.lower)), "")
    wanted = names.select(F.col(name_id).alias("name_id"), F.trim(F.col(name)).alias("name")).filter(F.length("name") >= least).distinct()
    wanted = wanted.withColumn("words", split(F.translate("name", _ALIKE, "sk"))).filter(F.size("words") > 0)
    asked = wanted.select(F.explode("words").alias("word")).distinct()
    # a long text travels once per word that some name has, as its identifier
    apart = lambda c: F.translate(c, _APART, "\ufdd0\ufdd1")
    rows = texts.select(F.col(text_id).alias("text_id"), apart(F.col(text)).alias("text")).filter("text IS NOT NULL")
    held = rows.select("text_id", F.explode(split("text")).alias("word")).join(asked, "word")
    # such a letter may end a word or stand in it: a text that has one may hold any word
    odd = rows.filter(F.col("text").rlike(f"[{_ALIKE}]")).select("text_id")
    held = held.unionByName(odd.crossJoin(asked).select("word", "text_id"))
    often = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.select("name_id", "name", F.explode("words").alias("word")).join(often, "word", "left").groupBy("name_id", "name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r"))
    pairs = held.join(rarest.filter("r.n > 0").select("name_id", "name", F.col("r.word").alias("word")), "word").select("text_id", "name_id", "name")
    asked_of = pairs.groupBy("text_id").agg(F.collect_set(F.struct("name_id", "name")).alias("names"))
    open_ended = f"[skSK{_ALIKE}]"
    before = lambda n: F.when(n.rlike("^" + open_ended), _BORDER).when(n.rlike("^[A-Za-z0-9_]"), "(?<![A-Za-z0-9_])").otherwise("(?<=[A-Za-z0-9_])")
    after = lambda n: F.when(n.rlike(open_ended + "$"), _BORDER).when(n.rlike("[A-Za-z0-9_]$"), "(?![A-Za-z0-9_])").otherwise("(?=[A-Za-z0-9_])")
    pattern = lambda n: F.concat(before(n), F.lit("(?iu:"), F.regexp_replace(apart(n), _SPECIAL, r"\\$1"), F.lit(")"), after(n))
    found = rows.join(asked_of, "text_id").select("text_id", F.explode(F.filter("names", lambda n: F.rlike(F.col("text"), pattern(n["name"])))).alias("n"))
    return found.select(F.col("text_id").alias(text_id), F.col("n.name_id").alias(name_id), F.col("n.name").alias("name")).distinct()


def longest(found: DataFrame, text_id: str) -> DataFrame:
    """Each text's names in order: longer ones first, of equals the first by the alphabet."""
    order = F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("size"), "name")))
    return found.groupBy(text_id).agg(F.transform(order, lambda x: x["name"]).alias("names"))
