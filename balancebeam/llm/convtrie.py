"""Prefix trie of sequences by van Emde Boas recursion: sequences are cut at half depth, cut prefixes are named, and the upper trie and the lower forests are built alike.

All subproblems of one recursion level are one Spark job, so there are as many rounds as the depth has binary digits, however deep the trie is:

1. blocks of turns get digests bottom-up (a block of 2s turns from its two halves);
2. from the widest block down, the upper half of every block is a cut prefix; its name is the smallest sequence id among those with the same forest and the same digest, and it is the
   forest of the lower half;
3. totals are grafted upward, from the narrowest blocks to the widest: the total of each root of a lower forest is added to its ancestors in the upper block.

A node is (depth, smallest member). Rows are single turns or blocks; nothing gathers a sequence or a node's members in one row. Sums and minima combine before their shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from balancebeam.llm.common import cut
from balancebeam.operators.positions import positions

WORD = r"[^\x20\x09-\x0D]+"


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, words): a row per turn, pos from 1 by turn (null first; ties by the digest). A null role or text is empty; rows without a conv_id are left out.

    The digest is SHA-256 over the role's length, the role and the text. words counts the words of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return positions(rows, ["conv"], [F.col("turn").asc_nulls_first(), F.col("digest").asc()]).select("conv", "pos", "digest", "words")


def share_heads(turns: DataFrame, group: int = 20, modulus: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, pos, digest, words) and (conv, len), a row per conversation.

    Conversation c has the first h turns of conversation c - c % group (all if fewer, none if absent), then its own turns after its first h; h = crc32(decimal c) % modulus.
    """
    own = cut(turns)
    convs = own.groupBy("conv").agg(F.max("pos").alias("n")).select("conv", "n", (F.col("conv") - F.col("conv") % group).alias("base"), (F.crc32(F.col("conv").cast("string")) % modulus).alias("h"))
    first = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    heads = cut(convs.join(first, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("head"), "n"))
    shared = own.where((F.col("pos") < modulus) & (F.col("conv") % group == 0)).withColumnRenamed("conv", "base")
    front = heads.select("conv", "base", "h").join(shared, "base").where("pos <= h").select("conv", "pos", "digest", "words")
    back = own.join(heads.select("conv", "h", "head"), "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "words")
    return cut(front.unionAll(back)), heads.select("conv", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))


def upper_halves(turns: DataFrame, span: int) -> dict[int, DataFrame]:
    """For s = 1, 2, ... span / 2: (conv, i, up), the digest of the upper half (s turns) of the i-th block of 2s turns, where the sequence has it whole."""
    out, blocks, s = {}, turns.select("conv", (F.col("pos") - 1).alias("i"), "digest"), 1
    while s < span:
        half = F.col("i") % 2
        pair = cut(blocks.groupBy("conv", F.floor(F.col("i") / 2).alias("i")).agg(F.max(F.when(half == 0, F.col("digest"))).alias("up"), F.max(F.when(half == 1, F.col("digest"))).alias("low")))
        out[s] = pair.select("conv", "i", "up")
        blocks = pair.where("low is not null").select("conv", "i", F.unhex(F.sha2(F.concat("up", "low"), 256)).alias("digest"))
        s *= 2
    return out


def name_prefixes(turns: DataFrame, members: DataFrame, span: int, root: int) -> DataFrame:
    """(conv, d, name) for every prefix length d from 0: name is the smallest conv whose first d turns are the same."""
    halves, s = upper_halves(turns, span), span // 2
    top = members.select("conv", F.lit(0).cast("long").alias("i"), F.lit(root).cast("long").alias("forest"))
    state, named = top, top.select("conv", F.lit(0).cast("long").alias("d"), F.col("forest").alias("name"))
    while s:
        have = state.join(halves[s], ["conv", "i"])
        # in a table of their own, so that the skew join can split the rows of a prefix that many share
        names = cut(have.groupBy("i", "forest", "up").agg(F.min("conv").alias("name")))
        lower = cut(have.join(names, ["i", "forest", "up"]).select("conv", "i", "name"))
        named = named.unionAll(lower.select("conv", (F.col("i") * (2 * s) + s).alias("d"), "name"))
        state = state.select("conv", (F.col("i") * 2).alias("i"), "forest").unionAll(lower.select("conv", (F.col("i") * 2 + 1).alias("i"), F.col("name").alias("forest")))
        s //= 2
    return cut(named)


def graft(own: DataFrame, paths: DataFrame, span: int, sums: list[str]) -> DataFrame:
    """Subtree sums of ``own`` (conv, d, *sums). paths: (conv, d, name), the ancestors of each node's smallest member."""
    total, s = own, 1
    while s < span:
        lower = total.where(F.col("d") % (2 * s) == s).select("conv", F.floor(F.col("d") / (2 * s)).alias("j"), *sums)
        upper = paths.where(F.col("d") % (2 * s) < s).select("conv", F.floor(F.col("d") / (2 * s)).alias("j"), "d", "name")
        grafts = lower.join(upper, ["conv", "j"]).select(F.col("name").alias("conv"), "d", *sums)
        total = cut(total.unionAll(grafts).groupBy("conv", "d").agg(*[F.sum(x).alias(x) for x in sums]))
        s *= 2
    return total


def ids_digest(ends: DataFrame) -> DataFrame:
    """(conv, d, sha): SHA-256 over the decimal ids in column member of each (conv, d), ascending, joined by commas. Rows stream through the hash, so a node of any size takes no memory;
    as SHA-256 is sequential, one task reads the ids of one node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for b in batches:
            conv, d, member = b.columns[0].to_numpy(), b.columns[1].to_numpy(), b.columns[2].to_numpy()
            new = [0, *((conv[1:] != conv[:-1]) | (d[1:] != d[:-1])).nonzero()[0] + 1, len(conv)] if len(conv) else [0]
            out = []
            for x, y in zip(new, new[1:]):
                text = ",".join(map(str, member[x:y].tolist())).encode()
                if at == (conv[x], d[x]):
                    state.update(b"," + text)
                else:
                    out += [(*at, state.hexdigest())] if at else []
                    at, state = (conv[x], d[x]), hashlib.sha256(text)
            yield _rows(out)
        yield _rows([(*at, state.hexdigest())] if at else [])

    return ends.select("conv", "d", "member").repartition("conv", "d").sortWithinPartitions("conv", "d", "member").mapInArrow(run, "conv long, d long, sha string")


def _rows(rows: list) -> pa.RecordBatch:
    conv, d, sha = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(d, pa.int64()), pa.array(sha, pa.string())], names=["conv", "d", "sha"])


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (conv, pos, digest, words), pos from 1 without gaps; turns with equal digests are equal. ``members``: (conv, len), every sequence once, also those without turns. n_leaves
    and saved_tokens sum over the node's subtree, itself included: childless nodes, and (n_convs - 1) times the words of the node's last turn. ends_sha256 hashes the members that end at the
    node. No member at all gives no row.
    """
    turns, members = cut(turns), cut(members.select("conv", F.col("len").cast("long").alias("len")))
    deepest, root = members.agg(F.max("len"), F.min("conv")).first()
    span = 1 << int(deepest or 0).bit_length()  # beyond the deepest node
    named = name_prefixes(turns, members, span, root if root is not None else 0)
    paths = named.select("conv", "d", "name")
    nodes = named.groupBy(F.col("name").alias("conv"), "d").agg(F.count("*").alias("n"))
    last = turns.select("conv", F.col("pos").alias("d"), "words")
    above = paths.select("conv", (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = cut(nodes.join(last, ["conv", "d"], "left").join(above, ["conv", "d"], "left").select("conv", "d", "n", "parent", F.coalesce("words", F.lit(0)).alias("words")))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("conv"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["conv", "d"], "left").na.fill(0, ["n_children"]))
    own = nodes.select("conv", "d", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved_tokens"))
    total = graft(own, paths, span, ["n_leaves", "saved_tokens"])
    ends = members.select(F.col("conv").alias("member"), F.col("conv"), F.col("len").alias("d")).join(paths, ["conv", "d"]).select(F.col("name").alias("conv"), "d", "member")
    out = nodes.join(total, ["conv", "d"]).join(ids_digest(ends), ["conv", "d"], "left")
    return out.select(
        F.col("conv").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, group: int = 20, modulus: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations (see ``share_heads``). Columns beside conv_id, turn, role and text are not read; rows that repeat are turns of their own; an empty table gives no row."""
    return prefix_trie(*share_heads(turns_of(conversations), group, modulus))
