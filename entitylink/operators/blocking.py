"""Block keys, buckets with caps, candidate joins.

Two ways, which give different candidates: ``engine`` joins on (strategy, key), caps buckets and names the
first strategy that finds a pair; ``fast`` joins on the key alone within a raw country.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from .probe import Probe


@dataclass(frozen=True)
class Rules:
    """Which groups of keys are made."""

    aliases: bool = True
    transliteration: bool = True
    countryless: bool = True
    specific: bool = True
    identity: bool = False
    char4: bool = True


#: Baseline, each addition alone, and all (fixed presets of the ablation).
ABLATION = {
    "B0": Rules(False, False, False, False),
    "B1": Rules(True, False, False, False),
    "B2": Rules(False, True, False, False),
    "B3": Rules(False, False, True, False),
    "B4": Rules(False, False, False, True),
    "B5": Rules(),
    "B6": Rules(identity=True),
}
OVERFLOWING = ("name_prefix_country", "street_prefix_country", "name_char4_country", "address_char4_country")
SPECIFIC = ("name_street_prefix_spec", "name_prefix_postal_spec", "name_prefix_addr_tok_spec")


def _key(strategy: str, *parts: Column) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), F.concat_ws("|", *parts).alias("key"))


def _one(strategy: str, when: Column, *parts: Column) -> Column:
    return F.when(when, F.array(_key(strategy, *parts))).otherwise(F.array().cast("array<struct<strategy:string,key:string>>"))


def _each(strategy: str, values: Column, c: Column, least: int = 0, cut: int | None = None) -> Column:
    picked = F.filter(values, lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))) >= max(1, least))
    return F.transform(picked, lambda v: _key(strategy, c, F.left(F.replace(v, F.lit(" "), F.lit("")), F.lit(cut)) if cut else v))


def specific_keys(country: Column | None = None) -> Column:
    """The narrow keys that stand in for overflowing buckets."""
    c = F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit("__unknown__")) if country is None else country
    n, has = F.col("name_prefix"), F.col("name_prefix") != ""
    token = F.get(F.filter("street_tokens", lambda t: (F.length(t) >= 5) & ~t.rlike("^[0-9]+$")), F.lit(0))
    postal = F.get(F.col("postal_codes"), F.lit(0))
    return F.concat(_one(SPECIFIC[0], has & (F.col("street_prefix") != ""), c, n, F.col("street_prefix")), _one(SPECIFIC[1], has & postal.isNotNull(), c, n, F.left(postal, F.lit(3))), _one(SPECIFIC[2], has & token.isNotNull(), c, n, token))


def keys(rules: Rules = Rules()) -> Column:
    """All keys of a normalised record in the order of strategies, as an array of (strategy, key)."""
    c = F.coalesce(F.nullif(F.col("country_code"), F.lit("")), F.lit("__unknown__"))
    core, street = F.col("name_core"), F.col("street_core")
    houses = F.flatten(F.transform("house_numbers", lambda h: F.transform("postal_codes", lambda p: F.concat_ws("|", h, p))))
    none = F.array().cast("array<struct<strategy:string,key:string>>")
    char4 = lambda s, col: F.transform(col, lambda g: _key(s, c, g)) if rules.char4 else none
    parts = [
        _one("name_exact_country", core != "", c, core),
        _one("name_prefix_country", core != "", c, F.col("name_prefix")),
        char4("name_char4_country", F.col("name_char4")),
        _one("address_exact_country", street != "", c, street),
        _one("street_prefix_country", street != "", c, F.col("street_prefix")),
        char4("address_char4_country", F.col("address_char4")),
        _one("name_address_exact_country", (core != "") & (street != ""), c, core, street),
        F.transform(houses, lambda hp: _key("house_postal_country", c, hp)),
        F.transform("domains", lambda d: _key("domain_country", c, d)),
    ]
    if rules.aliases:
        # alias by alias: the first strategy of a pair depends on it
        def of_alias(a: Column) -> Column:
            start = F.left(F.replace(a, F.lit(" "), F.lit("")), F.lit(4))
            long = F.length(start) >= 4
            return F.concat(F.array(_key("alias_exact_country", c, a)), _one("alias_prefix_country", long, c, start), _one("name_prefix_country", long, c, start), _each("alias_token_country", X.tokens(a), c, 4))

        parts.append(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.concat("aliases", "domain_names")), of_alias))))
    else:
        parts.append(F.transform("aliases", lambda a: _key("alias_country", c, a)))
    if rules.transliteration:
        latin = F.when(F.col("translit_core") != "", F.col("translit_core")).otherwise(core)
        words = F.when(F.col("translit_core") != "", F.col("translit_tokens")).otherwise(F.col("name_tokens"))
        parts += [_one("translit_exact_country", latin != "", c, latin), _each("translit_prefix_country", F.array(latin), c, 3, 3), _each("translit_token_country", F.array_distinct(words), c, 4)]
    if rules.countryless:
        any_ = F.lit("__any__")
        parts += [_one("name_exact_countryless", (core != "") & F.col("country_code").isin("", "unknown", "__unknown__"), any_, core), F.transform(houses, lambda hp: _key("house_postal_countryless", any_, hp))]
    if rules.specific:
        parts.append(specific_keys(c))
    if rules.identity:
        parts.append(F.transform(X.identity_keys(F.coalesce("business_name", F.lit(""))), lambda k: _key("secondary_identity_country", c, k)))
    return F.concat(*parts)


def emit(normalized: DataFrame, id_as: str, rules: Rules = Rules()) -> DataFrame:
    """(id, source, ordinal, strategy, key), a row for each key."""
    return normalized.select(F.col("entity_id").alias(id_as), "source", F.posexplode(keys(rules)).alias("ordinal", "k")).select(id_as, "source", "ordinal", "k.strategy", "k.key")


def postings(targets: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Distinct (strategy, key, target_source, target_id)."""
    p = emit(targets, "target_id", rules)
    return p.select("strategy", "key", F.col("source").alias("target_source"), "target_id").distinct()


def buckets(posts: DataFrame, cap: int = 500) -> DataFrame:
    """Size of each bucket over all target sources and whether it passes the cap."""
    return posts.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("bucket_size")).withColumn("capped", F.col("bucket_size") > cap)


#: All strategies of ``keys``.
STRATEGIES = (
    "name_exact_country", *OVERFLOWING, "address_exact_country", "name_address_exact_country", "house_postal_country", "domain_country", "alias_country", "alias_exact_country", "alias_prefix_country", "alias_token_country",
    "translit_exact_country", "translit_prefix_country", "translit_token_country", "name_exact_countryless", "house_postal_countryless", *SPECIFIC, "secondary_identity_country",
)


def probe(s1: DataFrame, targets: DataFrame | None, cap: int = 500, rules: Rules = Rules(), index: tuple[DataFrame, DataFrame] | None = None) -> Probe:
    """The written index of the targets and the buckets of each S1: pairs, their numbers and lists of ids come from it."""
    posts = index[0] if index else emit(targets, "target_id", rules).withColumnRenamed("source", "target_source").drop("ordinal")
    return Probe(emit(s1, "source1_id", rules).drop("source"), posts, cap, STRATEGIES, OVERFLOWING, SPECIFIC if rules.specific else (), index[1].where("capped") if index else None)


def candidates(s1: DataFrame, targets: DataFrame | None, cap: int = 500, rules: Rules = Rules(), index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(source1_id, target_source, target_id, strategy, hits): pairs that share an uncapped bucket.

    ``strategy`` is that of the pair's first key; a capped prefix or 4-gram bucket is searched through the
    record's specific keys, which gives the name ``<strategy>_smart_overflow`` at the capped key's place.
    The cap bounds the fan-out of every key; ``hits`` counts the keys that find the pair.  ``index``, the postings
    and buckets of the targets, stands in for them where it has been written before.
    """
    return probe(s1, targets, cap, rules, index).pairs()


def fast_candidates(s1: DataFrame, targets: DataFrame, cap: int = 50) -> DataFrame:
    """(source1_id, target_source, target_id): the in-memory runner's way.

    Keys of all strategies share one space within a raw country; 4-gram and street-prefix strategies make no
    keys, and the specific keys are entered once more, so that those named for neither count twice.  A bucket is
    usable up to ``cap`` entries; a full one is searched through the usable specific keys.
    """
    made = keys(Rules())
    main = F.filter(made, lambda k: ~(k["strategy"].contains("char4") | k["strategy"].contains("street_prefix")))
    raw = F.col("country")
    entries = targets.select(raw.alias("c"), F.col("source").alias("target_source"), F.col("entity_id").alias("target_id"), F.explode(F.concat(F.transform(main, lambda k: k["key"]), F.transform(specific_keys(), lambda k: k["key"]))).alias("key"))
    size = entries.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n"))
    usable = size.where(F.col("n") <= cap).select("c", "key")
    member = entries.distinct().join(usable, ["c", "key"])
    # the specific keys are also made by the first loop's filter unless they are street prefixes
    probe = s1.select(raw.alias("c"), F.col("entity_id").alias("source1_id"), F.explode(F.transform(main, lambda k: k["key"])).alias("key"), F.transform(specific_keys(), lambda k: k["key"]).alias("spec")).distinct()
    direct = probe.select("c", "key", "source1_id").join(member, ["c", "key"])
    full = probe.join(size.where(F.col("n") > cap).select("c", "key"), ["c", "key"]).select("c", "source1_id", F.explode("spec").alias("key")).distinct()
    over = full.join(member, ["c", "key"])
    cols = ["source1_id", "target_source", "target_id"]
    return direct.select(*cols).unionByName(over.select(*cols)).distinct()


def key_report(posts: DataFrame) -> DataFrame:
    """One row: distinct keys, entries and entities of an index, and the strategy with the most entries."""
    per = posts.groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))
    top = per.agg(F.max(F.struct("n", "strategy"))["strategy"].alias("largest_strategy"))
    return posts.agg(F.countDistinct("strategy", "key").alias("keys"), F.count(F.lit(1)).alias("entries"), F.countDistinct("target_source", "target_id").alias("entities")).join(F.broadcast(top))  # one row each


def net_new(hits: DataFrame, base: DataFrame) -> DataFrame:
    """(strategy, channel, n): the pairs of ``hits`` that ``base`` lacks, by strategy."""
    k = ["source1_id", "target_source", "target_id"]
    new = hits.join(base.select(*k).distinct(), k, "left_anti")
    return new.groupBy("strategy").agg(F.count(F.lit(1)).alias("n")).select("strategy", channel(F.col("strategy")).alias("channel"), "n")


def bucket_report(size: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(counts of keys, capped ones and the rows in them; the largest buckets)."""
    total = size.agg(F.count(F.lit(1)).alias("keys"), F.sum(F.col("capped").cast("long")).alias("capped_keys"), F.coalesce(F.sum(F.when(F.col("capped"), F.col("bucket_size"))), F.lit(0)).alias("capped_rows"), F.max("bucket_size").alias("largest"), F.avg("bucket_size").alias("mean_size"))
    return total, size.orderBy(F.col("bucket_size").desc(), "strategy", "key").limit(most)


def channel(strategy: Column) -> Column:
    """The group that a strategy is reported in (fixed names)."""
    has = strategy.contains
    return F.when(has("alias"), "alias_channel").when(has("translit"), "transliteration_channel").when(has("countryless"), "country_fallback_channel").when(has("exact") | has("prefix") | has("char4"), "smart_capping_subkeys").otherwise("other")


# -- the older key sets -------------------------------------------------------------------------


def _joined(strategy: str, mark: str, *parts: Column) -> Column:
    return F.struct(F.lit(strategy).alias("strategy"), F.concat_ws("_", F.col("country_code"), F.lit(mark), *parts).alias("key"))


def _if(when: Column, *keys: Column) -> Column:
    return F.when(when, F.array(*keys)).otherwise(F.array().cast("array<struct<strategy:string,key:string>>"))


def _plain_domain(d: Column) -> Column:
    for tld in (".com", ".org", ".net"):
        d = F.replace(d, F.lit(tld), F.lit(""))
    return F.replace(d, F.lit("."), F.lit("_"))


def old_keys() -> Column:
    """Ten passes over a normalised record, as an array of (strategy, key)."""
    pack = lambda x: F.replace(x, F.lit(" "), F.lit(""))
    clean, core, street = F.col("name_clean"), F.col("name_core"), F.col("street_core")
    name = pack(F.when(core != "", core).otherwise(clean))
    houses = F.flatten(F.transform("house_numbers", lambda h: F.transform("postal_codes", lambda p: _joined("hn_postal", "hnpc", h, p))))
    return F.concat(
        _if(clean != "", _joined("exact_name", "en", clean)), _if((core != "") & (core != clean), _joined("exact_name", "en", core)), _if(street != "", _joined("exact_addr", "ea", street)),
        _if((clean != "") & (street != ""), _joined("exact_name_addr", "ena", clean, street)), _if(F.length(name) >= 4, _joined("name_prefix", "np", F.left(name, F.lit(6)))),
        _if(F.length(pack(street)) >= 4, _joined("street_prefix", "sp", F.left(pack(street), F.lit(8)))), F.transform("name_char4", lambda g: _joined("name_4grams", "n4g", g)), F.transform("address_char4", lambda g: _joined("addr_4grams", "a4g", g)),
        houses, F.transform("domains", lambda d: _joined("domain", "dom", _plain_domain(d))), F.transform(F.filter("aliases", lambda a: F.trim(a) != ""), lambda a: _joined("dba_alias", "alias", F.trim(a))),
    )


def classic_keys(stop_words: bool = True) -> Column:
    """Five channels of a normalised record, and the ten passes, whose name prefix stands for the channel of that name."""
    rare = lambda t, stops: ~t.isin(*stops) if stop_words else F.lit(True)
    core, street = F.col("name_core"), F.col("street_core")
    none = F.array().cast("array<struct<strategy:string,key:string>>")
    houses = F.flatten(F.transform("house_numbers", lambda h: F.concat(_if((F.length(h) >= 3) | h.contains("/"), _joined("address_core", "hn", h)), _if(street != "", _joined("address_core", "h", h, F.left(street, F.lit(4)))))))
    postal = F.flatten(F.transform("postal_codes", lambda p: F.concat(F.array(_joined("postal_name", "p", p)), _if(core != "", _joined("postal_name", "p", p, F.left(core, F.lit(3)))))))
    name = F.transform(F.filter(F.slice("name_tokens", 1, 3), lambda t: (F.length(t) >= 3) & rare(t, T.NAME_STOP_WORDS)), lambda t: _joined("name_token", "n", t))
    address = F.transform(F.filter("street_tokens", lambda t: (F.length(t) >= 5) & ~t.rlike("^[0-9]+$") & rare(t, T.ADDRESS_STOP_WORDS)), lambda t: _joined("address_token", "at", t))
    alias = F.flatten(F.transform("aliases", lambda a: F.transform(F.slice(F.filter(F.split(a, " "), lambda t: (F.length(t) >= 3) & rare(t, T.NAME_STOP_WORDS)), 1, 2), lambda t: _joined("domain_alias", "alias", t))))
    domain = F.transform("domains", lambda d: _joined("domain_alias", "dom", _plain_domain(d)))
    return F.concat(F.coalesce(houses, none), F.coalesce(postal, none), name, address, domain, alias, old_keys())


def truncated_index(entries: DataFrame, cap: int) -> DataFrame:
    """(key, target_id) of the first ``cap`` entries of each key by ``seq``; Spark keeps only that many per task before the exchange."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq", "target_id")
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def probe_by_key(own: DataFrame, posts: DataFrame, cap: int) -> DataFrame:
    """The older index: keys of any strategy, skipped above ``cap`` rows; hits and sorted strategies of each pair."""
    usable = posts.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap).select("key")
    hit = own.select("source1_id", "key").distinct().join(usable, "key").join(posts, "key")
    return hit.groupBy("source1_id", "target_id").agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("strategy")).alias("strategies"))
