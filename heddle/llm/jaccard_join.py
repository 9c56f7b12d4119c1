"""N-gram Jaccard join: a blocked sparse matrix product of document by n-gram incidence.

Two texts link if ``den * overlap >= num * union`` for their sets of distinct n-word shingles.  Words are ASCII
lower-cased and cut at ASCII white space; a text of fewer words is one shingle; an empty one has none and links nothing.

1. Texts with equal sets fall into one class (a 128-bit sum of their shingles); from here on a class is one row.
2. The columns (shingles) get one order for all rows: rare ones first.  What is frequent is found by counting the
   lowest-hashed shingles of all texts; at most ``max_heavy`` of the most frequent ones are sent out, which bounds the
   broadcast and only affects the order, never the result.
   Columns beyond that number are dealt with by shuffles.
3. Linked rows must share one of their first ``n - ceil(t n) + 1`` columns.  The product of these parts of the rows
   accumulates overlaps for each pair, and a pair stays only if its sizes and the best overlap that it can still reach
   allow a link: of the two, the row whose first columns end earlier in the order shares no others of them, so the
   overlap is at most what was counted plus the rest of that row.  A column with more than ``light`` rows isn't multiplied out: its rows are tied to their smallest member
   (by size class), which keeps every possible pair inside one group without listing pairs.
4. The groups that these pairs and ties form (connected components) hold every link.  Each row of a group gets its
   whole text once per pair of blocks; blocks have a bounded number of rows and shingles (a few times ``block``), and a group of any size is
   spread over its block pairs.  The product of two blocks gives exact overlaps, and so the links.
5. Links come back as a spanning forest and as counts per class, and components give the result.

Defined results: null texts are empty; repeated rows give a row each; a row with a null id is returned with its own
size, no links and a null component, unless its class has an id; only the id and text columns are read; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import by_ids, components, cut, map_columns, meet, mix, settle, shingle_sets, signed, stored


def class_key(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: equal for equal sets, and only for them but for hash collisions."""
    a, b = mix(tokens + np.uint64(0x51ED270B)).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0xA5A5A5A5F00DFACE)).sum(dtype=np.uint64)
    both = signed(mix(np.array([a ^ (b << np.uint64(1)), b], np.uint64)))
    return int(both[0]), int(both[1])


def prefix_length(n: int, num: int, den: int) -> int:
    return n + (-num * n // den) + 1


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def join(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, light: int = 50, max_heavy: int = 500_000, block: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, n_links) of every row.

    ``component_id`` is the smallest id reachable by links, ``n_links`` the number of other rows that a row links with,
    copies included.
    """
    settle(docs.sparkSession)
    rows = _texts(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def measure(ids, texts):
        sets = shingle_sets(texts, n)
        keys = [class_key(t) if len(t) else None for t in sets]
        return ids, [len(t) for t in sets], [k and k[0] for k in keys], [k and k[1] for k in keys]

    id_kind = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    sized = cut(map_columns(rows, measure, f"id {id_type}, n int, ck long, proof long", [id_kind, pa.int32(), pa.int64(), pa.int64()], ["id", "n", "ck", "proof"]))
    classes = sized.where("n > 0").groupBy("ck", "proof", "n").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    # one row for each class stands for it: the rows whose id is the smallest of its class
    repeated = cut(classes.where("copies > 1").select("ck", "proof", "first"))
    # one class may hold very many rows: they stay where they are, unless there are very many such classes
    repeated = F.broadcast(repeated) if repeated.count() <= 500_000 else repeated
    copies = sized.join(repeated, ["ck", "proof"]).where("id > first").select("id").distinct()
    copies = cut(copies.join(classes.select(F.col("first").alias("id")), "id", "left_anti"))
    single = by_ids(rows, copies, "id", "left_anti")

    heavy, all_found = _heavy(single, n, num, den, light, max_heavy)
    prefixes = _prefixes(single, n, num, den, docs.sparkSession.sparkContext.broadcast(heavy))
    ties = _candidates(prefixes, num, den, light, not all_found)
    groups = components(ties).withColumnRenamed("component", "grp")

    members = cut(groups.join(classes.where("first is not null"), groups["id"] == classes["ck"]).select("grp", "ck", "n", "copies", F.col("first").alias("id")))
    links = cut(_products(rows, members, n, num, den, block, id_type))
    # what is in neither of these is a class of one row without links
    whole = components(links.where("b is not null").select("a", "b")).select(F.col("id").alias("ck"), "component")
    linked = cut(classes.join(whole, "ck").select("ck", "proof", "first", "copies", "component"))
    smallest = cut(linked.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("classes")))
    degree = links.where("b is null").groupBy(F.col("a").alias("ck")).agg(F.sum("w").alias("w"))
    named = meet(linked, smallest, ["component"], "classes").join(degree, "ck", "left").select("ck", "proof", "component_id", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    alone = classes.where("copies > 1").join(whole, "ck", "left_anti").select("ck", "proof", F.col("first").alias("component_id"), (F.col("copies") - 1).alias("n_links"), "copies")
    out = meet(sized, cut(named.union(alone)), ["ck", "proof"], "copies", "left")
    return out.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def _order(tokens: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A row's columns in the common order, by hash among the rare ones, and their ranks (0: rare)."""
    known, ranks = heavy
    if not len(known):
        return tokens, np.zeros(len(tokens), np.int32)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    rank = np.where(known[at] == tokens, ranks[at], 0)
    order = np.argsort(rank, kind="stable")
    return tokens[order], rank[order]


def _heavy(single: DataFrame, n: int, num: int, den: int, light: int, max_heavy: int, passes: int = 3) -> tuple[tuple[np.ndarray, np.ndarray], bool]:
    """Frequent columns, sorted, with their rank by count, and whether these are all that rows have in front.

    The first columns of all rows are counted; frequent ones move to the end of the order, which brings other columns to
    the front of the rows that had them, so these are counted again, until nothing frequent is found or after ``passes``;
    what is left then is found by a join, at the cost of one more shuffle instead of one more pass over the texts each.
    """
    known: dict[int, int] = {}
    heavy = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    for _ in range(passes):
        sent = single.sparkSession.sparkContext.broadcast(heavy)

        def front(texts, sent=sent):
            out = []
            for tokens in shingle_sets(texts, n):
                keep = prefix_length(len(tokens), num, den) if len(tokens) else 0
                order, rank = _order(tokens, sent.value)
                new = order[:keep][rank[:keep] == 0]
                if keep and (not len(sent.value[0]) or len(new) < keep or (new != tokens[:keep]).any()):
                    out.append(signed(new))
            return [out]

        counted = map_columns(single.select("text"), front, "tokens array<long>", [pa.list_(pa.int64())], ["tokens"]).select(F.explode("tokens").alias("token")).groupBy("token").count()
        got = counted.where(F.col("count") > light).orderBy(F.desc("count"), "token").limit(max(1, max_heavy - len(known))).toPandas()
        if not len(got):
            return heavy, True
        if len(known) >= max_heavy:
            break
        known |= dict(zip(got["token"].tolist(), got["count"].tolist(), strict=True))
        tokens, counts = np.fromiter(known, np.int64).view(np.uint64), np.fromiter(known.values(), np.int64)
        ranks = np.empty(len(tokens), np.int32)
        ranks[np.lexsort((tokens, counts))] = np.arange(1, len(tokens) + 1)
        order = np.argsort(tokens)
        heavy = tokens[order], ranks[order]
    return heavy, False


def _prefixes(single: DataFrame, n: int, num: int, den: int, sent) -> DataFrame:
    """(token, heavy, ck, n): the first columns of each row in the common order, and whether it is a frequent one."""

    def first(texts):
        sets = [t for t in shingle_sets(texts, n) if len(t)]
        ordered = [_order(t, sent.value) for t in sets]
        keep = [prefix_length(len(t), num, den) for t in sets]
        rare = [min(k, int(np.count_nonzero(rank == 0))) for (_, rank), k in zip(ordered, keep, strict=True)]
        return [class_key(t)[0] for t in sets], [len(t) for t in sets], [signed(o[:r]) for (o, _), r in zip(ordered, rare, strict=True)], [signed(o[r:k]) for (o, _), r, k in zip(ordered, rare, keep, strict=True)]

    list_ = pa.list_(pa.int64())
    arrays = map_columns(single.select("text"), first, "ck long, n int, rare array<long>, heavy array<long>", [pa.int64(), pa.int32(), list_, list_], ["ck", "n", "rare", "heavy"])
    both = F.explode(F.array(F.struct(F.col("rare").alias("tokens"), F.lit(False).alias("heavy")), F.struct(F.col("heavy").alias("tokens"), F.lit(True).alias("heavy")))).alias("e")
    return arrays.select("ck", "n", both).select("ck", "n", "e.heavy", F.explode("e.tokens").alias("token"))


def _candidates(prefixes: DataFrame, num: int, den: int, light: int, open_ended: bool) -> DataFrame:
    """(a, b): pairs that may still link, and for columns with many rows a tie of each row to its smallest neighbour.

    Rows of rare columns are counted by a window, where none has many; rows of frequent columns, of which there are at most
    ``max_heavy``, meet their counts in a broadcast.  If frequent columns may be missing (``open_ended``), all are joined.
    """
    found = stored(prefixes)
    rare, heavy = found.where("not heavy").drop("heavy"), found.where("heavy").drop("heavy")
    often = cut(heavy.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    dense = heavy.join(F.broadcast(often), "token")
    if open_ended:
        plain = rare.join(rare.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    else:
        plain = rare.withColumn("df", F.expr("count(*) OVER (PARTITION BY token)")).where("df > 1")
    counted = stored(plain.unionByName(dense))
    few, many = counted.where(F.col("df") <= light), counted.where(F.col("df") > light)
    x, y = few.select("token", F.col("ck").alias("a"), F.col("n").alias("na")), few.select("token", F.col("ck").alias("b"), F.col("n").alias("nb"))
    fit = F.expr(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
    pairs = x.join(y, "token").where((F.col("a") < F.col("b")) & fit).groupBy("a", "b").agg(F.count("*").alias("o"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    # beyond its first columns a row has ceil(t n) - 1 more
    rest = f"greatest(({num} * na + {den - 1}) DIV {den}, ({num} * nb + {den - 1}) DIV {den}) - 1"
    reach = pairs.where(f"{num + den} * (o + {rest}) >= {num} * (na + nb)").select("a", "b")
    # sizes within the ratio fall into one class or two neighbouring ones
    classed = many.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + 1e-9).cast("int"))
    heads = cut(classed.groupBy("token", "s").agg(F.min("ck").alias("head")))
    heads = F.broadcast(heads) if heads.count() <= 500_000 else heads  # else a shuffled join, whose large keys Spark splits
    own = classed.join(heads, ["token", "s"]).select(F.col("ck").alias("a"), F.col("head").alias("b"))
    next_ = heads.select("token", (F.col("s") - 1).alias("s"), F.col("head").alias("b"))
    across = heads.join(next_, ["token", "s"]).select(F.col("head").alias("a"), "b")
    return reach.union(own).union(across)


def _products(rows: DataFrame, members: DataFrame, n: int, num: int, den: int, block: int, id_type: str) -> DataFrame:
    """(a, b, w): a spanning forest of the links inside each block pair (w null), and linked rows per class (b null)."""
    # blocks by size: running sums over the sizes of a group, not over its rows; rows of one size are spread by hash
    heft = F.col("n") + F.lit(block // 1000)
    sizes = members.groupBy("grp", "n").agg(F.sum(heft).alias("heft"))
    before = F.sum("heft").over(Window.partitionBy("grp").orderBy("n")) - F.col("heft")
    sizes = sizes.select("grp", "n", F.floor(before / block).cast("int").alias("at"), F.ceil(F.col("heft") / block).cast("int").alias("parts"))
    blocks = members.join(sizes, ["grp", "n"]).withColumn("blk", (F.col("at") + F.pmod(F.xxhash64("ck"), F.col("parts"))).cast("int"))
    spans = blocks.groupBy("grp", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    other = spans.select("grp", F.col("blk").alias("blk2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = spans.join(other, "grp").where(f"blk <= blk2 AND {num} * lo2 <= {den} * hi AND {num} * lo <= {den} * hi2").select("grp", F.col("blk").alias("i"), F.col("blk2").alias("j"))
    first = blocks.join(pairs.select("grp", F.col("i").alias("blk"), "i", "j"), ["grp", "blk"])
    second = blocks.join(pairs.where("i < j").select("grp", F.col("j").alias("blk"), "i", "j"), ["grp", "blk"])
    wanted = first.union(second).select("id", "grp", "i", "j", "blk", "ck", "copies")
    met = by_ids(rows, wanted, "id", "inner", 300_000)
    dealt = met.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "blk", "ck").select("grp", "i", "j", "blk", "ck", "copies", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, len(batch), 500):
                columns = [c.to_pylist() for c in batch.slice(at, 500).columns]
                for grp, i, j, blk, ck, copies, tokens in zip(*columns[:-1], shingle_sets(columns[-1], n), strict=True):
                    if key != (grp, i, j):
                        out += _link(held, key, num, den) if held else []
                        key, held = (grp, i, j), {}
                    if ck not in held and class_key(tokens)[0] == ck:
                        held[ck] = (blk, copies, tokens)
                if len(out) > 50_000:
                    yield _rows(out)
                    out = []
        out += _link(held, key, num, den) if held else []
        yield _rows(out)

    return dealt.mapInArrow(run, "a long, b long, w long")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "w"])


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """The product of two incidence blocks: shared shingles of each left and right row."""
    if len(left) * len(right) <= 64:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in right] for x in left], np.int64).reshape(len(left), len(right))
    total = np.zeros((len(left), len(right)), np.float64)
    row_l, row_r = (np.repeat(np.arange(len(s)), [len(t) for t in s]) for s in (left, right))
    tok_l, tok_r = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(tok_l, tok_r)  # other columns add nothing
    col_l, col_r = np.searchsorted(shared, tok_l), np.searchsorted(shared, tok_r)
    on_l, on_r = (np.flatnonzero((c < len(shared)) & (shared[np.minimum(c, len(shared) - 1)] == t)) if len(shared) else np.zeros(0, int) for c, t in ((col_l, tok_l), (col_r, tok_r)))
    on_l, on_r = on_l[np.argsort(col_l[on_l], kind="stable")], on_r[np.argsort(col_r[on_r], kind="stable")]
    for start in range(0, len(shared), width):
        part = []
        for on, col, row, size in ((on_l, col_l, row_l, len(left)), (on_r, col_r, row_r, len(right))):
            lo, hi = np.searchsorted(col[on], [start, start + width])
            dense = np.zeros((size, min(width, len(shared) - start)), np.float32)
            dense[row[on[lo:hi]], col[on[lo:hi]] - start] = 1
            part.append(dense)
        total += part[0] @ part[1].T
    return total.astype(np.int64)


def _link(held: dict, key: tuple, num: int, den: int) -> list[tuple]:
    _, i, j = key
    left = [(ck, c, t) for ck, (blk, c, t) in held.items() if blk == i]
    right = left if i == j else [(ck, c, t) for ck, (blk, c, t) in held.items() if blk == j]
    if not left or not right:
        return []
    shared = overlaps([t for _, _, t in left], [t for _, _, t in right])
    sizes = np.array([len(t) for _, _, t in left])[:, None] + np.array([len(t) for _, _, t in right])[None, :]
    linked = den * shared >= num * (sizes - shared)
    if i == j:
        np.fill_diagonal(linked, False)
    copies_l, copies_r = np.array([c for _, c, _ in left]), np.array([c for _, c, _ in right])
    out = [(ck, None, int(w)) for (ck, _, _), w in zip(left, linked @ copies_r, strict=True) if w]
    if i != j:
        out += [(ck, None, int(w)) for (ck, _, _), w in zip(right, linked.T @ copies_l, strict=True) if w]
    # a spanning forest, by depth-first search over rows of the link matrix
    todo_l, todo_r = np.ones(len(left), bool), np.ones(len(right), bool)
    for seed in range(len(left)):
        if not todo_l[seed]:
            continue
        todo_l[seed] = False
        stack = [(True, seed)]
        while stack:
            is_left, at = stack.pop()
            new = np.flatnonzero(linked[at] & todo_r) if is_left else np.flatnonzero(linked[:, at] & todo_l)
            for x in new.tolist():
                pair = (left[at][0], right[x][0]) if is_left else (left[x][0], right[at][0])
                out.append((min(pair), max(pair), None))
                (todo_r if is_left else todo_l)[x] = False
                stack.append((not is_left, x))
    return out


def deduplicate(docs: DataFrame, joined: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of each component: that of its smallest id; all columns stay, null ids and repeated ids too."""
    gone = joined.where(F.col("component_id") < F.col(id_col)).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
