"""Mixing sources to target weights.

Weights run down a tree (domain, language, source); each leaf gets a token budget. What a
leaf cannot deliver, because its documents times the allowed repeats are too few, goes to its
siblings by their weights, then to its ancestors' siblings. A leaf uses all its documents for
as many whole epochs as its budget holds, and a prefix, by tokens, of one further epoch in a
seeded order. The prefix is found from token sums of order-key bins, so no task ever sorts a
whole leaf: only the one bin in which the budget ends is ordered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import prepare, written

BINS = 4096
MAX_LEAVES = 100_000

_CODERS: dict[str, object] = {}


def _coder(path: str):
    """The tokenizer of a vocabulary file: tiktoken ranks, sentencepiece or tokenizers JSON."""
    if path not in _CODERS:
        if path.endswith(".tiktoken"):
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            enc = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            _CODERS[path] = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            _CODERS[path] = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tk = Tokenizer.from_file(path)
            tk.encode_special_tokens = True
            _CODERS[path] = lambda texts: [len(x.ids) for x in tk.encode_batch(texts, add_special_tokens=False)]
    return _CODERS[path]


def default_vocabulary() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(docs: DataFrame, columns: list[str], text_col: str, vocabulary: str | None = None) -> DataFrame:
    """``columns`` and ``tokens``, the length of each whole text in tokens (0 for a null)."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _coder(path)
        for b in batches:
            n = count([t or "" for t in b.column(b.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "tokens"])

    src = docs.select(*columns, F.col(f"`{text_col}`").alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in src.drop("_text").dtypes) + ", tokens bigint"
    return src.mapInArrow(run, schema)


@dataclass
class Node:
    """A node of the weight tree; leaves have tokens and a capacity."""

    weight: float
    children: dict[str, Node] = field(default_factory=dict)
    tokens: int = 0
    capacity: float = 0.0
    budget: float = 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children.values()) if self.children else self.capacity

    def give(self, budget: float) -> None:
        """Hand a budget down; what a child cannot use goes to its siblings by weight."""
        self.budget = min(budget, self.room())
        if not self.children:
            return
        kids = [self.children[k] for k in sorted(self.children)]
        share = {id(k): 0.0 for k in kids}
        left, open_ = self.budget, [k for k in kids if k.room() > 0]
        while open_ and left > 1e-9:
            total = sum(k.weight for k in open_)
            each = {id(k): left * (k.weight / total if total > 0 else 1 / len(open_)) for k in open_}
            full = [k for k in open_ if share[id(k)] + each[id(k)] >= k.room() - 1e-9]
            if not full:
                for k in open_:
                    share[id(k)] += each[id(k)]
                break
            for k in full:
                left -= k.room() - share[id(k)]
                share[id(k)] = k.room()
            open_ = [k for k in open_ if k not in full]
        for k in kids:
            k.give(share[id(k)])


def plan(leaves: list[tuple[tuple[str, ...], float, int, int]], total: float | None = None) -> dict[tuple[str, ...], tuple[float, int]]:
    """Budget and tokens of each leaf (path, weight, tokens, max_repeats).

    The total defaults to the tokens of all leaves once.
    """
    root = Node(1.0)
    for path, weight, tokens, repeats in leaves:
        node = root
        for p in path:
            node = node.children.setdefault(p, Node(0.0))
            node.weight += weight
        node.tokens, node.capacity = tokens, float(tokens) * repeats
    root.give(float(sum(x[2] for x in leaves)) if total is None else total)
    out = {}
    for path, *_ in leaves:
        node = root
        for p in path:
            node = node.children[p]
        out[path] = (node.budget, node.tokens)
    return out


def mix(docs: DataFrame, targets: DataFrame, levels: tuple[str, ...] = ("domain", "language", "source"), id_col: str = "doc_id", text_col: str = "text",
        total: float | None = None, seed: int = 1, vocabulary: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn documents and the shares reached.

    ``targets`` has the columns of ``levels`` that exist in ``docs`` (others are taken as one
    branch), target_share and max_repeats. Drawn: (doc_id, source, uses, tokens), ``uses``
    times each. Shares: (source, target_share, actual_share, tokens_available, tokens_drawn,
    documents, uses). Documents whose source is null or has no target, and those of zero
    tokens, are never drawn; a target without documents gets actual share 0. Each stored row
    counts as a document of its own. ``total`` defaults to the tokens of all targets once.
    """
    spark = prepare(docs.sparkSession)
    have = [c for c in levels if c in docs.columns and c in targets.columns]
    leaf = F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in have]))
    want = targets.select(leaf.alias("leaf"), F.concat_ws("/", *have).alias("source"), F.array(*[F.col(f"`{c}`").cast("string") for c in have]).alias("path"), "target_share", "max_repeats").filter(
        " and ".join(f"path[{i}] is not null" for i in range(len(have)))
    )
    keyed = docs.withColumn("leaf", leaf).select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), "leaf", F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null and text is not null")
    counted = written(count_tokens(keyed, ["doc_id", "leaf"], "text", vocabulary).filter("tokens > 0"))
    size = counted.groupBy("leaf").agg(F.sum("tokens").alias("tokens"))
    rows = want.join(size, "leaf", "left").fillna(0, ["tokens"]).limit(MAX_LEAVES + 1).collect()
    if len(rows) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} targets")
    budget = plan([(tuple(r.path), float(r.target_share or 0), int(r.tokens), int(r.max_repeats or 0)) for r in rows], total)
    spec = []
    for r in rows:
        b, n = budget[tuple(r.path)]
        epochs = int(min(b // n, r.max_repeats)) if n else 0
        rest = round(b - epochs * n, 6) if n and epochs < r.max_repeats else 0.0  # a budget of 7 tokens is not 6.9999999
        spec.append((r.leaf, r.source, float(r.target_share or 0), epochs, float(rest), int(n)))
    spec = spark.createDataFrame(spec, "leaf string, source string, target_share double, epochs int, rest double, available bigint")
    key = F.xxhash64(F.lit(seed), F.col("epochs"), F.col("doc_id"), F.col("tokens"))
    d = counted.join(F.broadcast(spec), "leaf").withColumn("key", key).withColumn("bin", F.shiftrightunsigned("key", 64 - 12).cast("int"))
    bins = d.groupBy("leaf", "bin").agg(F.sum("tokens").alias("t"))
    before = F.sum("t").over(Window.partitionBy("leaf").orderBy("bin")) - F.col("t")
    edge = F.broadcast(bins.withColumn("before", before).select("leaf", "bin", "before", "t").join(F.broadcast(spec.select("leaf", "rest")), "leaf")
                       .filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("t") > F.col("rest"))).select("leaf", F.col("bin").alias("edge"), "before"))
    d = d.join(edge, "leaf", "left")
    inside = d.filter("bin = edge").withColumn("upto", F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy(F.expr("shiftright(key, 1)"), "key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    cols = ["doc_id", "leaf", "source", "tokens"]
    last = inside.select(*cols, (F.col("epochs") + (F.col("upto") <= F.col("rest")).cast("int")).alias("uses"))
    others = d.filter("edge is null or bin <> edge").select(*cols, (F.col("epochs") + F.coalesce((F.col("bin") < F.col("edge")).cast("int"), F.when(F.col("rest") > 0, 1).otherwise(0))).alias("uses"))
    drawn = written(others.unionByName(last).filter("uses > 0").select("doc_id", "leaf", "source", "uses", "tokens"))
    got = drawn.groupBy("leaf").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens_drawn"), F.count("*").alias("documents"), F.sum("uses").alias("uses"))
    whole = F.sum("tokens_drawn").over(Window.partitionBy())
    shares = spec.join(got, "leaf", "left").fillna(0, ["tokens_drawn", "documents", "uses"]).select(
        "source", "target_share", (F.col("tokens_drawn") / F.when(whole > 0, whole)).alias("actual_share"), F.col("available").alias("tokens_available"), "tokens_drawn", "documents", "uses"
    )
    return drawn.drop("leaf"), shares
