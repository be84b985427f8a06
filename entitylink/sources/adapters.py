"""The sample tables as records of three sources.

A document's first sentence is its name and the second its address; its language is the country, and its
source's number decides between S1, S2 and S3.  So that domains, aliases, house numbers and postal codes occur,
records get them by their numbers: every seventh is nothing but a domain, the one after it names that domain's
label as its alias, and two of three addresses end with a house number and a postal code (the sentence's own
numbers are left out).

A target matches the first S1 with the same sentence as its address.  A record that names an S1's domain matches
that S1, and after every 50th S1 record the next one does, whatever it says: matches that keys may miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a small table is one row group, so one task: its rows are dealt to all cores; a large one has tasks enough
    cores = spark.sparkContext.defaultParallelism
    if d.rdd.getNumPartitions() < 2 * cores:
        d = d.select("doc_id", "text", "lang", "source").repartition(cores)
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id")
    s = F.concat(F.lit("S"), (F.coalesce(F.replace("source", F.lit("src"), F.lit("")).try_cast("int"), F.lit(0)) % 3 + 1).cast("string"))
    name = F.trim(F.regexp_extract(text, r"^[^.!?\n]*", 0))
    # ß as ss: house numbers are told from postal codes by places in the capitalised text, which ß makes longer
    street = F.replace(F.trim(F.regexp_replace(F.regexp_extract(text, r"^[^.!?\n]*[.!?\n]+([^.!?\n]*)", 1), "[0-9]+", "")), F.lit("ß"), F.lit("ss"))
    house = (F.length(street) % 89 + 1).cast("string")
    house = F.when(n % 4 == 0, F.concat(house, F.lit("/7"))).when(n % 4 == 1, F.concat(house, F.lit("-9"))).otherwise(house)
    postal = (10_000 + F.length(street) * 37 % 900).cast("string")
    shop = lambda k: F.concat(F.lit("shop"), k.cast("string"))
    return d.select(
        s.alias("source"), F.concat(s, F.lit("-"), n.cast("string")).alias("entity_id"),
        F.when(n % 7 == 0, F.concat(F.lit("www."), shop(n), F.lit(".com"))).when(n % 7 == 1, F.concat(name, F.lit(" d/b/a "), shop(n - 1))).otherwise(name).alias("business_name"),
        F.when(n % 7 == 0, F.lit("")).when(n % 3 != 2, F.concat_ws(" ", street, house, postal)).otherwise(street).alias("business_address"), F.coalesce("lang", F.lit("")).alias("country"),
    )


def truth(records: DataFrame) -> DataFrame:
    """(source1_id, target_source, target_id), each pair once."""
    words = F.trim(F.regexp_replace(F.regexp_replace(F.lower("business_address"), r"[0-9/\-]+", " "), r"\s+", " "))
    r = records.select("source", "entity_id", words.alias("street"), F.substring_index("entity_id", "-", -1).cast("long").alias("n"))
    long = r.where(F.size(F.split("street", " ")) >= 3)
    first = long.where("source = 'S1'").groupBy("street").agg(F.min("entity_id").alias("source1_id"))
    target = [F.col("source").alias("target_source"), F.col("entity_id").alias("target_id")]
    same = long.where("source <> 'S1'").join(first, "street").select("source1_id", *target)
    s1 = r.where("source = 'S1' AND (n % 7 = 0 OR n % 50 = 0)").select((F.col("n") + 1).alias("n"), F.col("entity_id").alias("source1_id"))
    return same.unionByName(r.where("source <> 'S1'").join(s1, "n").select("source1_id", *target)).distinct()
