"""Prefix tree of conversations, by collapsing equal ones into weighted sequences.

Rebuilt conversations that are equal turn by turn are one sequence with a weight and a list of
the conversations that end there. A sequence that is a proper prefix of another is no leaf, which
an anti-join finds. Every node of the tree is a prefix of some sequence, so sums over the
prefixes of the weighted sequences give each node its figures; the conversations themselves are
not unfolded again.

A prefix is known by the exclusive or, over its turns, of digests of place, role and text (120
bits, cut from SHA-256 and MD5), so prefixes of any length come out of running sums. A long conversation
is worked on in stretches of places whose totals are put in front of the next, and the order of
turns comes out of a sort over ranges, so that no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarlens.session import written

#: Conversations whose ids agree but for the last digits share the first turns of one of them.
FAMILY = 100
#: A conversation takes fewer than so many turns from the first of its family.
HEADS = 6
#: Places that are summed up in one stretch.
STRETCH = 1024
#: Ends of a sequence, by id, that are joined into one string before they are hashed.
PACK = 4096


def _xor(name: str) -> Column:
    return F.coalesce(F.bit_xor(name), F.lit(0).cast("long"))


def _part(digest: Column, start: int) -> Column:
    """60 bits of a hexadecimal digest as a number."""
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, place, turn_id, size): turns numbered from 1 in each conversation.

    Sorted over ranges of (conversation, turn, role, text), numbered within a range, and shifted
    by what the earlier ranges hold of the same conversation.
    """
    told = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    turn_id = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    ranged = written(told.repartitionByRange(*keys).sortWithinPartitions(*keys).select(
        "conv", turn_id.alias("turn_id"), F.char_length("text").alias("size"),
        F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "turns")
    held = ranged.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    # one row per range that a conversation reaches into
    before = Window.partitionBy("conv").orderBy("range")
    shift = held.select("conv", "range", (F.sum("n").over(before) - F.col("n")).alias("shift"))
    place = F.row_number().over(Window.partitionBy("conv", "range").orderBy("at"))
    return ranged.withColumn("local", place).join(shift, ["conv", "range"]).select(
        "conv", (F.col("local") + F.col("shift")).alias("place"), "turn_id", "size")


def rebuilt(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations with their family's first turns: (conv, n) and (conv, place, turn_id, size).

    Conversation ``c`` takes the first ``h`` turns of conversation ``c - c % family`` (all if it
    has fewer, none if it is absent) and then its own after the first ``h``, where ``h`` is the
    unsigned CRC-32 of the decimal id modulo ``heads``. Turns are ordered by number, nulls first,
    ties by role and text; a null role or text is empty. Rows without a conversation id belong
    to none and are left out. ``turn_id`` is a digest of role and text. The first table also has
    conversations without a turn left (``n`` is zero).
    """
    own = written(_ordered(turns, conv, turn, role, text), "ordered")
    taken = F.crc32(F.col("conv").cast("string")) % heads
    convs = own.groupBy("conv").agg(F.count(F.lit(1)).alias("n_own")).select(
        "conv", "n_own", (F.col("conv") - F.col("conv") % family).alias("base"), taken.alias("h"))
    first = own.where(F.col("place") < heads).groupBy(F.col("conv").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("place", "turn_id", "size"))).alias("first"))
    headed = written(convs.join(first, "base", "left").select(
        "conv", "h", "n_own", F.slice(F.coalesce("first", F.array().cast(
            first.schema["first"].dataType)), F.lit(1), F.col("h").cast("int")).alias("head")), "heads")
    head = headed.select("conv", F.explode("head").alias("x")).select("conv", "x.*")
    # only where the family's first is short do the own turns move up
    moved = headed.where(F.size("head") < F.col("h")).select(
        "conv", (F.col("h") - F.size("head")).alias("up"))
    tail = own.where(F.col("place") > taken).join(moved, "conv", "left").select(
        "conv", (F.col("place") - F.coalesce("up", F.lit(0))).alias("place"), "turn_id", "size")
    n = F.size("head") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    types = {"conv": "long", "place": "long", "turn_id": "string", "size": "long"}
    cast = lambda df: df.select(*[F.col(c).cast(t).alias(c) for c, t in types.items()])
    return (headed.select("conv", n.cast("long").alias("n")),
            cast(head).unionByName(cast(tail)))


def _hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per sequence over its strings in order, which come sorted; state of fixed size."""
    seq, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([seq[0]], pa.int64()), pa.array([seq[1]], pa.int64()),
             pa.array([seq[2]], pa.int64()), pa.array([state.hexdigest()])],
            ["k1", "k2", "n", "ends_sha256"])

    for batch in rows:
        for a, b, n, said in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if (a, b, n) != seq:
                if seq is not None:
                    yield done()
                seq, state = (a, b, n), hashlib.sha256(said.encode())
            else:
                state.update(b"," + said.encode())
    if seq is not None:
        yield done()


def prefix_tree(convs: DataFrame, places: DataFrame) -> DataFrame:
    """One row per distinct prefix of the given conversations, from the root without a turn.

    ``convs`` holds (conv, n), each conversation once; ``places`` their (conv, place, turn_id,
    size) with places 1 to n. Per node: ``conv_id`` (least member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``. No conversation gives no node. The ends of a sequence are hashed by one
    task, since SHA-256 is a chain, but as a stream of packed strings.
    """
    digest = F.md5(F.concat_ws(":", F.col("place").cast("string"), "turn_id"))
    marked = written(places.select("conv", "place", "size", _part(digest, 1).alias("a"),
                                   _part(digest, 17).alias("b")), "places")
    whole = marked.groupBy("conv").agg(_xor("a").alias("k1"), _xor("b").alias("k2"),
                                       F.sum("size").alias("length"))
    zero = F.lit(0).cast("long")
    known = written(convs.join(whole, "conv", "left").select(
        "conv", "n", *[F.coalesce(c, zero).alias(c) for c in ("k1", "k2", "length")]), "known")
    key = ["k1", "k2", "n"]
    seqs = known.groupBy(*key).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("rep"),
                                   F.first("length").alias("length"))
    packs = known.groupBy(*key, F.floor(F.col("conv") / PACK).alias("pack")).agg(
        F.sort_array(F.collect_list("conv")).alias("ids")).select(
        *key, "pack", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("said"))
    ends = packs.repartition(*key).sortWithinPartitions(*key, "pack").select(*key, "said").mapInArrow(
        _hashed, "k1 long, k2 long, n long, ends_sha256 string")

    # running keys of the representatives, stretch by stretch
    reps = marked.join(seqs.select(F.col("rep").alias("conv")), "conv", "left_semi").withColumn(
        "stretch", F.floor((F.col("place") - 1) / STRETCH))
    part = Window.partitionBy("conv", "stretch").orderBy("place")
    sums = reps.groupBy("conv", "stretch").agg(_xor("a").alias("ta"), _xor("b").alias("tb"),
                                               F.sum("size").alias("ts"))
    earlier = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    front = sums.select("conv", "stretch", *[F.coalesce(x, zero).alias(c) for c, x in (
        ("fa", F.bit_xor("ta").over(earlier)), ("fb", F.bit_xor("tb").over(earlier)),
        ("fs", F.sum("ts").over(earlier)))]).where("stretch > 0")
    running = reps.select("conv", "stretch", "place", "size", "a", "b",
                          F.bit_xor("a").over(part).alias("ra"), F.bit_xor("b").over(part).alias("rb"),
                          F.sum("size").over(part).alias("rs")).join(front, ["conv", "stretch"], "left")
    ahead = lambda c, f: F.col(c).bitwiseXOR(F.coalesce(f, zero))
    steps = running.select(
        F.col("conv").alias("rep"), F.col("place").alias("depth"), "size",
        ahead("ra", "fa").alias("p1"), ahead("rb", "fb").alias("p2"), "a", "b",
        (F.col("rs") + F.coalesce("fs", zero)).alias("upto"))
    roots = seqs.select("rep", *[zero.alias(c) for c in ("depth", "size", "p1", "p2", "a", "b", "upto")])
    told = seqs.select("rep", "weight", F.col("length").alias("total"))
    rows = written(steps.unionByName(roots).join(told, "rep"), "prefixes")

    node = ["p1", "p2", "depth"]
    # a sequence that another one goes on from is no leaf
    inner = rows.where("depth > 0").select(
        F.col("p1").bitwiseXOR(F.col("a")).alias("k1"), F.col("p2").bitwiseXOR(F.col("b")).alias("k2"),
        (F.col("depth") - 1).alias("n")).distinct()
    leaves = seqs.join(inner, key, "left_anti").select("rep", F.lit(1).alias("leaf"))
    least = rows.groupBy(*node).agg(F.min("rep").alias("conv_id"))
    # each node is owned by its least member, which then owns all below it on its own path
    owned = rows.join(least, node).where("rep = conv_id").groupBy("rep").agg(
        (F.max("total") - F.min(F.col("upto") - F.col("size"))).alias("owned"))
    shares = seqs.select("rep").join(owned, "rep", "left").join(leaves, "rep", "left").select(
        "rep", F.coalesce("owned", zero).alias("owned"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    first = F.min(F.struct("rep", "total", "owned", "upto", "size", "a", "b"))
    nodes = written(rows.join(shares, "rep").groupBy(*node).agg(
        F.sum("weight").alias("n_convs"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * F.col("total")).alias("all_convs"), F.sum("owned").alias("all_owned"),
        first.alias("m")), "nodes")
    ahead_of = F.col("m.upto") - F.col("m.size")
    # what the members hold from here on, less the text of the subtree itself
    saved = (F.col("all_convs") - F.col("n_convs") * ahead_of
             - (F.col("all_owned") - F.col("m.owned") + F.col("m.total") - ahead_of))
    above = [F.col("p1").bitwiseXOR(F.col("m.a")).alias("q1"),
             F.col("p2").bitwiseXOR(F.col("m.b")).alias("q2"), (F.col("depth") - 1).alias("q_depth")]
    children = nodes.where("depth > 0").select(*above).groupBy("q1", "q2", "q_depth").agg(
        F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"),
                           F.col("depth").alias("q_depth"), F.col("m.rep").alias("parent_conv_id"))
    out = nodes.select(*node, *above, F.col("m.rep").alias("conv_id"), "n_convs", "n_leaves",
                       saved.alias("saved_tokens"))
    out = out.join(parents, ["q1", "q2", "q_depth"], "left").drop("q1", "q2", "q_depth")
    out = out.join(children.toDF(*node, "n_children"), node, "left").join(
        ends.toDF(*node, "ends_sha256"), node, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs",
                      F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
