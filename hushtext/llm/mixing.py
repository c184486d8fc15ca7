"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern: the set of sources that hold them, as an array says or as copies of one text
stand in several sources. Flow goes from patterns, by way of their sources, to the sources' quotas; a pattern
gives the words of its distinct texts once for nothing and again at costs that rise with each repetition, whichever source
they go to. The flow says how often all documents of a pattern (of its rows in one source, for copies) are taken, and how
many further words come from documents in the order of a seeded hash. The point where these end is
found from a histogram over hash buckets and the rows of one bucket, so no task sorts a whole source.
"""

from __future__ import annotations

from collections import deque
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType
from pyspark.sql.window import Window

from hushtext.llm._common import aside, spread_join, stored, text_print
from hushtext.llm.sharding import HASH_BITS, key_hash

#: Cost of a word taken for the first, second and third time; how often a row is taken at most.
REPEAT_COSTS = (0, 1, 3)
MOST = len(REPEAT_COSTS)
BUCKET_BITS = 12
#: Rows of a plan, some 100 bytes each, that are broadcast; beyond, joins shuffle.
BROADCAST_PATTERNS = 200_000
#: Columns that take() adds.
RESULTS = ("size", "times", "taken", "source_size", "target")
WORD = r"[^\x20\x09-\x0D]+"


def quotas(sizes: dict, weights: dict, most: float = MOST) -> dict:
    """The sum of sizes shared by weight; none gets over most times its size, the excess is shared again."""
    out, rest, total = {}, set(sizes), float(sum(sizes.values()))
    while rest:
        share = (total - sum(out.values())) / sum(weights[s] for s in rest)
        full = {s for s in rest if weights[s] * share > most * sizes[s]}
        out |= {s: most * sizes[s] if s in full else weights[s] * share for s in full or rest}
        rest -= set(out)
    return {s: float(out[s]) for s in sizes}


def levels(words: int, most: int, costs: tuple = REPEAT_COSTS) -> list[tuple[int, int]]:
    """Words and the cost of each: of a pattern of so many distinct words, of which most are given with repetitions.

    The costs of the first repetitions are told; beyond them, as for texts with many copies, each step is twice as
    wide as the one before, and its cost grows by one more. So there are few steps, however many copies.
    """
    out, left, width, cost, rise = [], most, words, 0, 1
    for c in costs:
        out.append((min(words, left), c))
        left, rise, cost = left - out[-1][0], c - cost + 1 if c > cost else rise, c
    while left > 0:
        width, cost, rise = 2 * width, cost + rise, rise + 1
        out.append((min(width, left), cost))
        left -= out[-1][0]
    return [x for x in out if x[0] > 0]


class Pattern(NamedTuple):
    """words of its distinct texts, by source the words that may go to it (rooms), and most: words that it gives in all."""

    words: int
    rooms: dict
    most: int

    @staticmethod
    def of(words: int, sources: list, times: int = MOST) -> Pattern:
        """Documents that stand for all of their sources: given so many times in all."""
        return Pattern(words, dict.fromkeys(sources, times * words), times * words)


def flow(patterns: dict[str, Pattern], targets: dict, costs: tuple = REPEAT_COSTS) -> dict[tuple[str, object], int]:
    """Words from each pattern to each of its sources: the most that quotas take, at the least cost. Patterns and sources
    that no pattern links are routed apart, as networks of their own."""
    root = {s: s for s in targets}

    def find(s):
        while root[s] is not s:
            root[s] = s = root[root[s]]
        return s

    for p in patterns.values():
        first = next(iter(p.rooms), None)
        for s in p.rooms:
            root[find(s)] = find(first)
    groups: dict = {}
    for name, p in patterns.items():
        if p.rooms:
            groups.setdefault(find(next(iter(p.rooms))), {})[name] = p
    out = {}
    for some in groups.values():
        out |= _network(some, {s: targets[s] for p in some.values() for s in p.rooms}, costs)
    return out


def _network(patterns: dict[str, Pattern], targets: dict, costs: tuple) -> dict[tuple[str, object], int]:
    """flow() in whole words, by shortest paths: all paths of the least cost at once, then those of the next one, so there
    are as many rounds as there are costs of a path, not as patterns."""
    names = [("start",), ("end",), *[("p", p) for p in patterns], *[("s", s) for s in targets]]
    node = {x: i for i, x in enumerate(names)}
    head, room, price, out = [], [], [], [[] for _ in names]

    def edge(a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[node[x]].append(len(head))
            head.append(node[y])
            room.append(c)
            price.append(w)
        return len(head) - 2

    links = {}
    for name, p in patterns.items():
        for width, cost in levels(p.words, p.most, costs) if p.words else ():
            edge(("start",), ("p", name), width, cost)
        for s, most in p.rooms.items():
            links[name, s] = edge(("p", name), ("s", s), most, 0)
    for s, target in targets.items():
        edge(("s", s), ("end",), round(target), 0)
    while True:
        far, line, queued = [float("inf")] * len(names), deque([0]), {0}
        far[0] = 0
        while line:
            x = line.popleft()
            queued.discard(x)
            for e in out[x]:
                if room[e] and far[x] + price[e] < far[head[e]]:
                    far[head[e]] = far[x] + price[e]
                    if head[e] not in queued:
                        queued.add(head[e])
                        line.append(head[e])
        if far[1] == float("inf"):
            return {k: room[e ^ 1] for k, e in links.items()}
        _fill(head, room, price, out, far)


def _fill(head: list, room: list, price: list, out: list, far: list) -> None:
    """Sends along edges of shortest paths what they take, until no such path is left: rounds of paths of the fewest edges."""
    while True:
        depth = {0: 0}
        line = deque([0])
        while line and 1 not in depth:
            x = line.popleft()
            for e in out[x]:
                y = head[e]
                if room[e] and y not in depth and far[x] + price[e] == far[y]:
                    depth[y] = depth[x] + 1
                    line.append(y)
        if 1 not in depth:
            return
        at, path, x = dict.fromkeys(depth, 0), [], 0
        while True:
            if x == 1:
                most = min(room[e] for e in path)
                for e in path:
                    room[e] -= most
                    room[e ^ 1] += most
                first = next(i for i, e in enumerate(path) if not room[e])
                x = head[path[first] ^ 1]
                del path[first:]
                continue
            while at[x] < len(out[x]):
                e = out[x][at[x]]
                if room[e] and far[x] + price[e] == far[head[e]] and depth.get(head[e]) == depth[x] + 1:
                    break
                at[x] += 1
            else:
                if not path:
                    break
                x = head[path.pop() ^ 1]
                at[x] += 1
                continue
            path.append(e)
            x = head[e]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weights(sources: list, cycle: tuple = (1, 2, 3)) -> dict:
    """Weights 1, 2, 3, repeating, over sources by code point, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}


def _json(sources: Column) -> Column:
    return F.to_json(sources, {"ignoreNullFields": "false"})


def plan(items: DataFrame, weights=cycle_weights) -> tuple[DataFrame, DataFrame]:
    """How often to take documents of each cell, and each source's size and target.

    items: hash, size, sources (array of those that hold the document), once (boolean: the first row of its text; of rows
    without copies true) and own: the row's source in an array of one, or null for a row that stands for all of
    its sources. A cell is a pattern, or its rows in one source. weights: from the list of sources. Cells: pattern, own (as
    JSON), times, cut: documents up to that hash are taken once more. Equal hashes go together. An empty table
    gives no rows; null sources are a source of their own.
    """
    spark = items.sparkSession
    cell = ["pattern", "cell"]
    items = items.select(_json(F.array_sort(F.array_distinct("sources"))).alias("pattern"), F.coalesce(_json(F.col("own")), F.lit("")).alias("cell"), "sources", "own", "once", "hash", "size")
    bucket = F.shiftright("hash", HASH_BITS - BUCKET_BITS)
    # one pass: the rows of a cell meet only as sums over hash buckets
    sums = [F.sum("size").alias("size"), F.sum(F.when(F.col("once"), F.col("size")).otherwise(0)).alias("words"), F.first("sources").alias("sources"), F.first("own").alias("own")]
    heap = stored(items.groupBy(*cell, bucket.alias("bucket")).agg(*sums), "mix-buckets")
    # patterns and their sources, not documents: the flow stands on the driver
    rows = heap.groupBy(*cell).agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.first("sources").alias("sources"), F.first("own").alias("own")).collect()
    patterns: dict = {}
    sizes: dict = {}
    total = 0
    for r in sorted(rows, key=lambda r: (r["pattern"], r["cell"])):
        if r["own"] is None:
            mine = list(dict.fromkeys(r["sources"]))
            patterns[r["pattern"]] = Pattern.of(r["size"], mine)
        else:
            mine, room = r["own"], MOST * r["size"]
            p = patterns.get(r["pattern"], Pattern(0, {}, 0))
            patterns[r["pattern"]] = Pattern(p.words + r["words"], p.rooms | {mine[0]: room}, p.most + room)
        total += r["size"]
        for s in mine:
            sizes[s] = sizes.get(s, 0) + r["size"]
    by = weights(list(sizes)) if callable(weights) else weights
    # a document of several sources counts for each of them, and the mix is as large as all documents
    counted = sum(sizes.values())
    scale = total / counted if counted else 1.0
    targets = {s: t for s, t in quotas({s: n * scale for s, n in sizes.items()}, by).items()} if sizes else {}
    sent = flow(patterns, targets)
    asked = []
    for r in rows:
        mine = r["own"] if r["own"] is not None else list(dict.fromkeys(r["sources"]))
        words = sum(sent.get((r["pattern"], s), 0) for s in mine)
        asked.append((r["pattern"], r["cell"], *divmod(words, r["size"])) if r["size"] else (r["pattern"], r["cell"], 0, 0))
    asked_df = spark.createDataFrame(asked, "pattern string, cell string, times long, more long")
    few = lambda df: F.broadcast(df) if len(asked) <= BROADCAST_PATTERNS else df
    w = Window.partitionBy(*cell).orderBy("bucket")
    edge = heap.join(few(asked_df), cell).withColumn("before", F.sum("size").over(w) - F.col("size")).where("before <= more and more < before + size").select(*cell, "bucket", "before", "more")
    edge = stored(edge, "mix-edges")  # a bucket for each cell
    near = items.withColumn("bucket", bucket).join(few(edge), [*cell, "bucket"]).groupBy(*cell, "hash", "before", "more").agg(F.sum("size").alias("size"))
    upto = Window.partitionBy(*cell).orderBy("hash")
    cuts = near.withColumn("before", F.col("before") + F.sum("size").over(upto) - F.col("size"))
    # the last document is taken if that comes nearer to what is asked
    cuts = cuts.where("2 * before + size <= 2 * more").groupBy(*cell).agg(F.max("hash").alias("last"))
    low = edge.select(*cell, (F.shiftleft("bucket", HASH_BITS - BUCKET_BITS) - 1).alias("low"))
    pattern_plan = asked_df.join(low, cell, "left").join(cuts, cell, "left").select(*cell, "times", F.coalesce("last", "low", F.lit(-1)).alias("cut"))
    source_plan = spark.createDataFrame([(s, int(n), round(targets[s], 6)) for s, n in sizes.items()], "mix_source string, source_size long, target double")
    return stored(pattern_plan, "mix-patterns"), source_plan


def take(docs: DataFrame, seed: str = "mix", source: str = "source", key: str = "doc_id", text: str = "text", weights=cycle_weights, copies: bool = True) -> DataFrame:
    """docs with size, times, taken, source_size, target; no text moves between machines.

    source: a column of one source, or an array of all sources that hold the document; then source_size and target
    are those of its first source in order. copies: rows of one source each that have equal texts are one document that all
    their sources hold: repeating it costs alike whichever source it counts for, and each source takes its own rows. Null
    texts have size 0 and take nothing; a null source is a source of its
    own, an array without a source takes nothing; rows with the same key, source and text are taken alike; a very long text counts
    whole; an empty table gives no rows. Columns of docs with these names are replaced.
    """
    docs = docs.drop(*RESULTS)
    several = isinstance(docs.schema[source].dataType, ArrayType)
    held = F.array_sort(F.array_distinct(F.coalesce(F.col(source), F.array().cast("array<string>")))) if several else F.array(F.col(source))
    hashed = key_hash(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    rows = docs.withColumns({"size": word_count(F.col(text)), "__hash": hashed, "__sources": held})
    own = F.lit(None).cast("array<string>") if several else F.array(F.col(source).cast("string"))
    if several or not copies:
        items = rows.select(F.col("__sources").cast("array<string>").alias("sources"), own.alias("own"), F.lit(True).alias("once"), F.col("__hash").alias("hash"), "size")
        rows = rows.withColumn("__members", F.col("__sources").cast("array<string>"))
    else:
        rows = rows.withColumn("__print", text_print(text))
        items = stored(rows.select("__print", own.alias("own"), F.col("__hash").alias("hash"), "size", F.monotonically_increasing_id().alias("row")), "mix-rows")
        shared = items.groupBy("__print").agg(F.array_sort(F.collect_set(F.struct(F.element_at("own", 1).alias("s")))).alias("found"), F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")  # sources, not rows
        shared = stored(shared.select(F.col("__print").alias("__its"), F.col("found.s").alias("__held"), "first", "n"), "mix-copies")
        items = spread_join(items, "__print", "hash", shared, "__its", "n")
        items = items.select(F.coalesce("__held", "own").alias("sources"), "own", F.coalesce(F.col("row") == F.col("first"), F.lit(True)).alias("once"), "hash", "size")
        rows = spread_join(rows, "__print", "__hash", shared.drop("first"), "__its", "n").withColumn("__members", F.coalesce("__held", own)).drop("__print", "__its", "__held")
    items = stored(items, "mix-items")
    patterns, sources = plan(items, weights)
    patterns = patterns.select(F.col("pattern").alias("__p"), F.col("cell").alias("__c"), F.col("times").alias("__times"), F.col("cut").alias("__cut"))
    sources = sources.select(F.col("mix_source").alias("__source"), "source_size", "target")
    patterns, sources = (F.broadcast(x) if x.count() <= BROADCAST_PATTERNS else x for x in (patterns, sources))
    rows = rows.withColumns({"__pattern": _json(F.array_sort(F.array_distinct("__members"))), "__cell": F.coalesce(_json(own), F.lit(""))})
    rows = rows.join(patterns, (F.col("__pattern") == F.col("__p")) & (F.col("__cell") == F.col("__c")), "left").join(sources, F.get("__sources", F.lit(0)).eqNullSafe(F.col("__source")) & (F.size("__sources") > 0), "left")
    times = F.when(F.col("size") == 0, 0).otherwise(F.coalesce(F.col("__times") + (F.col("__hash") <= F.col("__cut")).cast("long"), F.lit(0)))
    rows = rows.withColumn("times", F.least(times, F.lit(MOST)).cast("long")).withColumn("taken", F.col("times") * F.col("size"))
    return rows.select(*docs.columns, *RESULTS)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs, whatever their names."""
    rows, back = aside(docs, RESULTS)
    return back(take(rows, **options).where("times > 0").withColumn("__n", F.explode(F.expr("sequence(1, times)"))))


ORACLE = f"""
WITH items AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM items GROUP BY source),
ratio AS (SELECT *, 3.0::DOUBLE * source_size / w AS r, sum(source_size) OVER () AS total FROM src),
runs AS (
  SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY r, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY r, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM ratio),
lev AS (SELECT max((total - capped)::DOUBLE / open_w) FILTER (r >= (total - capped)::DOUBLE / open_w) AS level FROM runs),
quota AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, w * level) AS target FROM ratio, lev),
asked AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size END AS times,
         CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT % source_size END AS more
  FROM quota),
runs2 AS (
  SELECT i.*, a.source_size, a.target, a.times, a.more,
         sum(size) OVER (PARTITION BY i.source ORDER BY h) - size AS before
  FROM items i JOIN asked a ON i.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       size * least(3, times + CASE WHEN 2 * before + size <= 2 * more THEN 1 ELSE 0 END)::BIGINT AS taken
FROM runs2"""
