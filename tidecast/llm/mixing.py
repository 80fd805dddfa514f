"""Mixing sources to target weights by Sainte-Lague apportionment (operator 10): DataFrame functions only.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; a target stops at
twice its source's size, and the excess is shared again by weight until none is above. The share at which this ends has a closed form: with
sources ordered by cap per weight, the capped ones are those whose cap per weight is at most what is left per weight.

Quotas: words are handed out in blocks of equal size. Blocks go to sources by the highest quotients target / (2 k + 1), and within a source to
its shards by the highest quotients size / (2 k + 1). Only quotients near the cut are listed: every party keeps the blocks it has in any case
(its exact share less the bound by which rounding can move it), and the rest are ranked. Shards hold about ``SHARD_WORDS`` words, so a hot source is
many shards.

Selection: within a shard, documents are laid out in an order seeded by a hash of the id. A quota of whole rounds takes every
word once a round; what remains is a run of blocks from a seeded block on, in a circle. A quota stops at two rounds, so no document gives
more than twice its size. Sums of ``taken`` differ from the target by at most half a block plus one block per shard whose quota stops.

Defined results: a null text has size 0 and gives nothing; a null source is a source of its own; an empty table gives an empty
result; a mix without any words takes nothing; repeated rows are separate documents; all hashes are of the id, so reruns agree; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidecast.llm.common import query, scan, stored, words

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SHARD_WORDS = 2_000_000
MAX_BLOCK = 1024
SEED = "mix"


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): narrow rows; key is a seeded number from the id."""
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.col("doc_id").cast("string"))), 1, 12), 16, 10).cast("bigint")
    return docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), key.alias("key"))


def targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to (source, source_size); a row per source, so its windows are small."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("place", place).withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST)
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = W.orderBy("ratio", "place")
    before, after = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    left = F.lit(SHARE) * F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    s = s.withColumn("per_weight", left / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("ratio") <= F.col("per_weight"))
    level = F.min(F.when(~F.col("capped"), F.col("ratio"))).over(W.partitionBy())
    first = F.min_by("per_weight", F.when(~F.col("capped"), F.struct("ratio", "place"))).over(W.partitionBy())
    return s.withColumn("target", F.when(F.col("capped") | level.isNull(), F.col("cap").cast("double")).otherwise(F.col("weight") * first))


def sainte_lague(parties: DataFrame, votes: str, seats: Column, party: str, group: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``blocks``: ``seats`` (one number per group) handed to the parties of each group by the highest quotients
    votes / (2 k + 1); ties go to the first party. Parties without votes get none.

    A party's seats differ from its exact share by at most ``slack``: half its share of the number of parties, and two. Only quotients in that
    range are listed, a few rows a party.
    """
    g = W.partitionBy(*group)
    p = parties.withColumn("_all", F.sum(votes).over(g)).withColumn("_n", F.count("*").over(g)).withColumn("_seats", seats.cast("bigint"))
    part = F.try_divide(F.col(votes).cast("double"), F.col("_all"))
    p = p.withColumn("_slack", F.ceil(part * F.col("_n") / 2).cast("bigint") + 2)
    p = p.withColumn("_sure", F.greatest(F.lit(0).cast("bigint"), F.floor(part * F.col("_seats")).cast("bigint") - F.col("_slack")))
    p = p.withColumn("_open", F.col("_seats") - F.sum("_sure").over(g))
    q = p.where(F.col(votes) > 0).select(*group, party, votes, "_open", F.explode(F.sequence(
        F.col("_sure"), F.col("_sure") + 2 * F.col("_slack") + 1)).alias("_k"))
    best = W.partitionBy(*group).orderBy(F.desc(F.col(votes) / (2 * F.col("_k") + 1)), F.col(party).asc_nulls_last(), "_k")
    won = (q.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= F.col("_open"))
           .groupBy(*[F.col(c).alias(f"_g{i}") for i, c in enumerate((*group, party))]).agg(F.count("*").alias("_won")))
    same = [p[c].eqNullSafe(won[f"_g{i}"]) for i, c in enumerate((*group, party))]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return (p.join(won, on, "left").withColumn("blocks", F.when(F.col(votes) > 0, F.col("_sure") + F.coalesce("_won", F.lit(0))).otherwise(F.lit(0)))
            .select(*parties.columns, "blocks"))


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document.

    The text is read once; the rest works on narrow rows. Rows are dealt by (source, shard), so no source lands in one task.
    """
    rows = stored(sized(docs), "mix-sizes")
    shard = F.pmod(F.col("key"), F.col("shards"))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    total = F.sum("target").over(W.partitionBy())
    sources = sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.floor(total / (1 << 17)))).cast("bigint"))
    sources = sources.withColumn("all_blocks", F.round(total / F.col("block")).cast("bigint"))
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS)).cast("bigint"))
    quotas = sainte_lague(sources, "target", F.col("all_blocks"), "source")
    quotas = stored(quotas.select("source", "source_size", "target", "block", "shards", F.col("blocks").alias("source_blocks")), "mix-quotas")
    # one row per source on the right: Spark broadcasts it below its threshold and splits hot sources above it
    q = quotas.withColumnRenamed("source", "q_source")
    dealt = rows.join(q, rows["source"].eqNullSafe(q["q_source"])).drop("q_source").withColumn("shard", shard)
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"),
                                                  F.first("source_blocks").alias("source_blocks"))
    shards = sainte_lague(shards, "shard_size", F.col("source_blocks"), "shard", ("source",))
    shards = shards.select(F.col("source").alias("s_source"), F.col("shard").alias("s_shard"), "shard_size", "blocks")
    d = dealt.join(shards, dealt["source"].eqNullSafe(shards["s_source"]) & (dealt["shard"] == shards["s_shard"])).drop("s_source", "s_shard")
    line = W.partitionBy("source", "shard").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    size, z = F.col("size"), F.col("shard_size")
    d = d.withColumn("begin", F.coalesce(F.sum("size").over(line), F.lit(0)))
    d = d.withColumn("quota", F.least(F.col("blocks") * F.col("block"), MOST * z))
    d = d.withColumn("rounds", F.when(z > 0, F.floor(F.try_divide("quota", z))).otherwise(0)).withColumn("run", F.col("quota") - F.col("rounds") * z)
    seeded = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 12), 16, 10).cast("bigint")
    d = d.withColumn("start", F.when(z > 0, F.pmod(seeded, F.ceil(F.try_divide(z, F.col("block")))) * F.col("block")).otherwise(0))
    end, stop = F.col("begin") + size, F.col("start") + F.col("run")

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(end, hi) - F.greatest("begin", lo))

    part = overlap(F.col("start"), F.least(stop, z)) + overlap(F.lit(0), stop - z)
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("rounds") * size + part).cast("bigint").alias("taken"))


@query("op10_mixing")
def op10_mixing(spark, folder):
    """All documents mixed to the targets of their sources."""
    return mix(scan(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")
