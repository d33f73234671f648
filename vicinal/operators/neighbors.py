"""Distance-bounded self-join as an equi-join of grid buckets, and the counts drawn from it.

Points lie in square buckets of a cell (and z layer); a centre is copied to every bucket that its reach touches, so equal
bucket keys find every pair in reach and the distance is a residual condition. Wide buckets make few copies and many
comparisons, narrow ones the reverse; their width follows from the density of the points. Equal points are counted once with their number first, which keeps the row-identity and value-identity counts in one plan. The grouping by point
keeps the join's keys, so it needs no shuffle of its own.

A bucket that holds more than CROWD points would be one task's work, so it is cut in two along each axis, and its parts again, at most
DEEPEST times; the level is part of the key. Points go to the one part that they lie in, centres to all that they reach. The parts to cut are
counted first, and only where some cell and layer holds more than CROWD points at all; they are a broadcast of at most MOST_CUTS
rows, the most crowded ones first (the part that holds another always before it).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import sinks

#: A centre's reach is taken as longer by this part when it is copied, lest rounding misses a point at exactly the reach.
SLACK = 1e-9
#: Widths of buckets in units of the reach, and what a copied row costs in comparisons (measured on the test tables).
WIDTHS, COPY = (1, 2, 4, 8, 16, 32), 100.0
#: Sides of the squares of sums_by_squares() in units of the smallest radius, and points that they should hold. At 0.7 the diagonal is 0.99 of the radius.
SIDES, FULL = (1.4, 0.7, 0.35, 0.175, 0.0875, 0.04375), 16
#: Distances of squares are taken as longer or shorter by this part, lest rounding misplaces a point. Largest radius of a search in units of its smallest.
NEAR, SPREAD = 0.005, 4.0
#: Kinds of a row of sums_by_squares(), added up where it is both.
POINT, CENTRE = 1, 2
#: Points in a bucket before it is cut, cuts at most one in the other, cuts in all.
CROWD, DEEPEST, MOST_CUTS = 20_000, 8, 50_000
#: Points that one task of a search sorts and joins, so that it needs no disk, however few partitions the session's shuffles have.
TASK_POINTS = 500_000
#: Points up to which a task isn't divided.
LEAST_POINTS = 5_000


def _layer(z_mode: str) -> list[str]:
    return ["cell"] if z_mode == "continuous" else ["cell", "z"]


def bucket_width(points: DataFrame, reach: float, z_mode: str = "discrete") -> float:
    """The width of measured()."""
    return measured(points, reach, z_mode)[0]


def measured(points: DataFrame, reach: float, z_mode: str = "discrete") -> tuple[float, bool, int]:
    """The cheapest width: (1 + 2 / m) ** d copies of a centre against (m + 2) ** d reaches' worth of points to compare
    it with; whether some cell and layer holds more than CROWD points; how many points there are. One aggregate over the points tells all."""
    axes, keys = _axes(z_mode), _layer(z_mode)
    spans = points.groupBy(*keys).agg(F.count("*").alias("n"), *[(F.max(a) - F.min(a)).alias(a) for a in axes])
    room = F.lit(1.0)
    for a in axes:
        room = room * F.greatest(F.col(a), F.lit(reach))
    # Weighted by points, so that a few crowded cells count as what they cost.
    row = spans.agg((F.sum(F.col("n") * F.col("n") / room) / F.sum("n")).alias("density"), F.max("n").alias("most"), F.sum("n").alias("all")).first()
    held = (row["density"] or 0.0) * reach ** len(axes)
    cost = lambda m: COPY * (1 + 2 / m) ** len(axes) + held * (m + 2) ** len(axes)
    return (reach * min(WIDTHS, key=cost) if reach > 0 else 1.0), (row["most"] or 0) > CROWD, row["all"] or 0


def _dealt(rows: DataFrame, points: int, keys: list[str]) -> DataFrame:
    """rows dealt by keys. Of very many points a task gets TASK_POINTS or fewer, where the session's partitions would hold more, or be put together to more."""
    spark, parts = rows.sparkSession, -(-points // TASK_POINTS)
    if parts <= spark.sparkContext.defaultParallelism:
        return rows.repartition(*keys)
    return rows.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def crowded_buckets(points: DataFrame, width: float, z_mode: str = "discrete") -> list[tuple]:
    """(level, cell, [z,] place on each axis) of every bucket to cut: at each level those with more than CROWD points."""
    axes, layer = _axes(z_mode), _layer(z_mode)

    def over(own: DataFrame, level: Column) -> DataFrame:
        side = F.get(F.array(*[F.lit(width * 0.5**k) for k in range(DEEPEST)]), level)
        counts = own.groupBy(level.alias("level"), *layer, *[F.floor(F.col(a) / side).alias(f"g{a}") for a in axes]).agg(F.count("*").alias("n"))
        return counts.where(F.col("n") > CROWD).orderBy(F.desc("n"), "level", *layer, *[f"g{a}" for a in axes]).limit(MOST_CUTS)

    whole = over(points, F.lit(0)).collect()
    if not whole:
        return []
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    names = [*layer, *[f"g{a}" for a in axes]]
    listed = points.sparkSession.createDataFrame([tuple(r[c] for c in names) for r in whole], ", ".join(f"{c} {kinds.get(c, 'long')}" for c in names))
    inside = points.select(*layer, *axes, *[_bucket(a, width).alias(f"g{a}") for a in axes]).join(F.broadcast(listed), names, "left_semi").select(*layer, *axes)
    deeper = over(inside.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(DEEPEST - 1)))), F.col("level")).collect()
    every = sorted([*whole, *deeper], key=lambda r: (-r["n"], r["level"]))[:MOST_CUTS]
    return [(r["level"], *[r[c] for c in names]) for r in every]


def _at_level(rows: DataFrame, cuts: list[tuple], keys: list[str], finer) -> DataFrame:
    """rows (keys among them, of level 0) with ``level``, moved to parts wherever their bucket is cut. finer(level) gives for each axis's key the keys
    in the parts of the bucket that a row belongs to, as an array."""
    kinds = dict(rows.dtypes)
    rows = rows.withColumn("level", F.lit(0))
    for level in range(DEEPEST):
        own = [c[1:] for c in cuts if c[0] == level]
        if not own:
            break
        cut = rows.sparkSession.createDataFrame(own, ", ".join(f"{k} {kinds[k]}" for k in keys)).withColumn("level", F.lit(level)).withColumn("_cut", F.lit(True))
        rows = rows.join(F.broadcast(cut), [*keys, "level"], "left")
        for key, parts in finer(level + 1).items():
            rows = rows.withColumn(key, F.explode(F.when(F.col("_cut"), parts).otherwise(F.array(key))))
        rows = rows.withColumn("level", F.col("level") + F.when(F.col("_cut"), 1).otherwise(0)).drop("_cut")
    return rows


def _bucket(axis: str, width: float) -> Column:
    return F.floor(F.col(axis) / width)


def _axes(z_mode: str) -> list[str]:
    return ["x", "y", "z"] if z_mode == "continuous" else ["x", "y"]


def measure(metric: str, z_mode: str, prefix: str = "a_") -> Column:
    """Squared Euclidean distance, or Chebyshev distance for the grid, between a point and its centre."""
    d = [F.col(a) - F.col(prefix + a) for a in _axes(z_mode)]
    if metric == "grid":
        return F.greatest(*[F.abs(x) for x in d])
    return sum((x * x for x in d[1:]), d[0] * d[0])


def limit_of(reach: float, metric: str) -> float:
    return reach if metric == "grid" else reach * reach


def keyed(points: DataFrame, centres: DataFrame, reach: float, z_mode: str = "discrete", keep: tuple[str, ...] = (), keep_centre: tuple[str, ...] = (), width: float | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and centres with the keys on which those in reach of each other meet, a point once, a centre in every bucket that it reaches."""
    axes, far = _axes(z_mode), reach * (1 + SLACK)
    crowded = True
    if not width:
        width, crowded, _ = measured(points, reach, z_mode)
    cuts = crowded_buckets(points, width, z_mode) if crowded else []
    named = [*_layer(z_mode), *(f"g{a}" for a in axes)]
    own = points.select("cell", "x", "y", "z", "geneID", *keep, *[_bucket(a, width).alias(f"g{a}") for a in axes])
    other = centres.select("cell", "z", *[F.col(a).alias(f"a_{a}") for a in axes], F.col("geneID").alias("A"), *keep_centre)
    for a in axes:
        other = other.withColumn(f"g{a}", F.explode(F.sequence(F.floor((F.col(f"a_{a}") - far) / width), F.floor((F.col(f"a_{a}") + far) / width))))
    if z_mode == "continuous":
        other = other.drop("z")
    if not cuts:
        return own, other, named
    # Halving the width is exact, so the part of a bucket is one of two along each axis whatever the rounding.
    side = lambda level: width * 0.5**level
    reached = lambda a, level: F.sequence(
        F.greatest(2 * F.col(f"g{a}"), F.floor((F.col(f"a_{a}") - far) / side(level))), F.least(2 * F.col(f"g{a}") + 1, F.floor((F.col(f"a_{a}") + far) / side(level)))
    )
    own = _at_level(own, cuts, named, lambda level: {f"g{a}": F.array(_bucket(a, side(level))) for a in axes})
    other = _at_level(other, cuts, named, lambda level: {f"g{a}": reached(a, level) for a in axes})
    return own, other, [*named, "level"]


def matched(points: DataFrame, centres: DataFrame, reach: float, metric: str = "radius", z_mode: str = "discrete", keep: tuple[str, ...] = (), keep_centre: tuple[str, ...] = (), width: float | None = None) -> DataFrame:
    """All (point, centre) pairs of a cell (and z layer, if z is discrete) in reach, with ``near``: their measure.

    Columns: cell, z, bucket keys, x, y, geneID and keep of the point; A and keep_centre of the centre.
    """
    own, other, keys = keyed(points, centres, reach, z_mode, keep, keep_centre, width)
    joined = own.join(other, keys).withColumn("near", measure(metric, z_mode))
    return joined.where(F.col("near") <= limit_of(reach, metric)).drop(*[f"a_{a}" for a in _axes(z_mode)])


def met(points: DataFrame, reach: float, metric: str = "radius", z_mode: str = "discrete", width: float | None = None) -> DataFrame:
    """matched() of all distinct points with one another: cell, z, bucket keys, x, y, geneID, m (equal points) of the point, A and m_a of the centre, near.

    Where no cell and layer is crowded points move once, to their buckets, where equal ones are counted; as centres they are read from that very
    shuffle, and only the copies for other buckets move again. Elsewhere equal points are counted before they move, and crowded buckets are cut.
    """
    crowded, n = True, 0
    if not width:
        width, crowded, n = measured(points, reach, z_mode)
    if crowded:
        counted = points.groupBy("cell", "z", "x", "y", "geneID").agg(F.count("*").alias("m"))
        return matched(counted, counted.withColumnRenamed("m", "m_a"), reach, metric, z_mode, keep=("m",), keep_centre=("m_a",), width=width)
    axes, far = _axes(z_mode), reach * (1 + SLACK)
    # A layer is named by a hash, as rows with a double among the join's keys move once more for what follows; z itself is compared, too.
    layer = [] if z_mode == "continuous" else ["layer"]
    named = ["cell", *layer, *(f"g{a}" for a in axes)]
    own = points.select("cell", "x", "y", "z", "geneID", *[F.xxhash64(F.col("z") + 0.0).alias(c) for c in layer], *[_bucket(a, width).alias(f"g{a}") for a in axes])
    own = _dealt(own.where(" AND ".join(f"{c} IS NOT NULL" for c in ("x", "y", "z", *named))), n, named)  # no others meet a centre; said here, all readers share the shuffle
    counted = own.groupBy(*named, "x", "y", "z", "geneID").agg(F.count("*").alias("m"))
    here = counted.select(*named, *[F.col(a).alias(f"a_{a}") for a in ("x", "y", "z")], F.col("geneID").alias("A"), F.col("m").alias("m_a"))
    copies = here
    for a in axes:
        reached = F.sequence(F.floor((F.col(f"a_{a}") - far) / width), F.floor((F.col(f"a_{a}") + far) / width))
        copies = copies.withColumn(f"h{a}", F.explode(reached))
    elsewhere = copies.where(" OR ".join(f"h{a} <> g{a}" for a in axes)).drop(*(f"g{a}" for a in axes)).withColumnsRenamed({f"h{a}": f"g{a}" for a in axes})
    joined = counted.join(here.unionByName(_dealt(elsewhere.select(here.columns), n, named)), named).withColumn("near", measure(metric, z_mode))
    near = F.col("near") <= limit_of(reach, metric)
    # Not =, which would be a key.
    return joined.where(near & (F.col("z") <= F.col("a_z")) & (F.col("z") >= F.col("a_z")) if layer else near).drop("a_x", "a_y", "a_z")


def near_genes(points: DataFrame, reach: float, metric: str = "radius", z_mode: str = "discrete", centres: DataFrame | None = None, width: float | None = None) -> DataFrame:
    """For each distinct point the genes that have a centre in reach: cell, x, y, z, geneID, m (equal points), A, near (least measure)."""
    if centres is None:
        pairs = met(points, reach, metric, z_mode, width).drop("m_a")
    else:
        counted = points.groupBy("cell", "z", "x", "y", "geneID").agg(F.count("*").alias("m"))
        pairs = matched(counted, centres.select("cell", "z", "x", "y", "geneID").distinct(), reach, metric, z_mode, keep=("m",), width=width)
    keys = [c for c in pairs.columns if c != "near"]
    return pairs.groupBy(*keys).agg(F.min("near").alias("near"))


def weight(identity: str) -> Column:
    """What a distinct point counts: all equal rows (row), or one (value, pixel)."""
    return F.col("m") if identity == "row" else F.lit(1).cast("long")


def around(near: DataFrame, identity: str = "row", by_cell: bool = False) -> DataFrame:
    """A[, cell], n: points in reach of any A, the A themselves included. By pixel: distinct positions within a cell."""
    keys = ["A", "cell"] if by_cell else ["A"]
    if identity == "pixel":
        return near.select("A", "cell", "x", "y", "z").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    return near.groupBy(*keys).agg(F.sum(weight(identity)).alias("n"))


def pair_counts(near: DataFrame, identity: str = "row") -> DataFrame:
    """A, B, k: points of B in reach of any A, for A other than B."""
    return near.where("A <> geneID").groupBy("A", F.col("geneID").alias("B")).agg(F.sum(weight(identity)).alias("k"))


def pairs_and_around(near: DataFrame, identity: str = "row", by_cell: bool = False) -> tuple[DataFrame, DataFrame]:
    """pair_counts() and around() from one search: sums by A and gene and, by cell, by A and cell are written once, and both read them."""
    n, met_by = F.sum(weight(identity)), F.sum(weight(identity))
    if identity == "pixel":
        # A position is met by A with all its genes or with none, so it counts with the first; the window's keys hold the search's.
        at = [c for c in near.columns if c not in ("geneID", "m", "near")]
        near = near.withColumn("_first", F.row_number().over(Window.partitionBy(*at).orderBy("geneID")) == 1)
        met_by = F.count_if("_first")
    if by_cell:
        sums = near.groupingSets([["A", "geneID"], ["A", "cell"]], "A", "geneID", "cell").agg(F.grouping("cell").alias("_pair"), n.alias("n"), met_by.alias("met"))
    else:
        sums = near.groupBy("A", "geneID").agg(F.lit(1).alias("_pair"), n.alias("n"), met_by.alias("met"))
    sums = sinks.staged(sums, sinks.shared_path(near.sparkSession, "sums"))
    pairs = sums.where("_pair = 1 AND A <> geneID").select("A", F.col("geneID").alias("B"), F.col("n").alias("k"))
    if by_cell:
        return pairs, sums.where("_pair = 0").select("A", "cell", F.col("met").alias("n"))
    return pairs, sums.groupBy("A").agg(F.sum("met").alias("n"))


def pairs_and_around_by_squares(points: DataFrame, centres: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """pair_counts() and around() of points (x, y, geneID, cell) and centres, each distinct one counted once, for data of any density."""
    kinds = [rows.select("cell", "x", "y", "geneID", F.lit(kind).alias("kind")) for kind, rows in ((POINT, points), (CENTRE, centres))]
    return pairs_and_around_of(sums_by_squares(kinds[0].unionByName(kinds[1]), (reach,)), 0)


def pairs_and_around_of(sums: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """pair_counts() and around() of one of the radii of sums_by_squares()."""
    own = sums.select("A", "geneID", F.col(f"n{radius}").alias("n")).where("n > 0")
    return own.where("A <> geneID").select("A", F.col("geneID").alias("B"), F.col("n").alias("k")), own.groupBy("A").agg(F.sum("n").alias("n"))


def _square_side(placed: DataFrame, reach: float) -> tuple[float, int]:
    """The side of the squares of a search, the shortest at which they hold FULL points on average, and how many points there are. One aggregate tells both."""
    sides = [reach * s for s in SIDES]
    used = [F.approx_count_distinct(F.xxhash64("cell", _bucket("x", s), _bucket("y", s))).alias(f"s{k}") for k, s in enumerate(sides)]
    row = placed.agg(F.count("*").alias("n"), *used).first()
    return next((s for k, s in reversed(list(enumerate(sides))) if row["n"] >= FULL * row[f"s{k}"]), sides[0]), row["n"]


def sums_by_squares(placed: DataFrame, radii: tuple[float, ...], genes: DataFrame | None = None) -> DataFrame:
    """A, geneID, n0, n1 ...: how many points of a gene have a centre of A in reach, for each of the radii, which rise and aren't far from one another; written.

    placed: cell, x, y, geneID, kind (POINT, CENTRE or the sum of both); equal rows count once. genes: every geneID once, if known.

    Space is cut into squares, and what genes have a centre in a square is a set of bits. Squares wholly in reach of each other settle their genes
    without a distance. Where that settles most genes of a square, those that it doesn't are counted and taken from all. Only for a gene that is settled for
    some square neither way are the square's points compared with the centres of that gene in squares partly in reach. There are few such centres where
    points are dense, so the work grows with the points, not with their square; no row is made for each point and gene in reach.
    """
    spark, each = placed.sparkSession, range(len(radii))
    side, n = _square_side(placed, radii[0])
    parts = max(1, min(max(-(-n // TASK_POINTS), int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // LEAST_POINTS)))
    steps = int(radii[-1] / side * (1 + NEAR)) + 1  # squares further off are out of reach
    wide = 2 * steps  # side of a bucket of squares, in squares
    within_steps = [(r / side * (1 - NEAR)) ** 2 for r in radii]
    reached_steps = [(r / side * (1 + NEAR)) ** 2 for r in radii]
    square, theirs, bucket = ["cell", "sx", "sy"], ["cell", "tx", "ty"], ["cell", "bx", "by"]

    genes = (placed.select("geneID").distinct() if genes is None else genes.select("geneID")).where("geneID IS NOT NULL")
    numbers = sinks.lookup(sinks.numbered(genes.orderBy("geneID")).select("geneID", F.col("place").alias("no")), "gene-numbers")
    last, rest = divmod(numbers.count() - 1, 64)
    every = F.when(F.col("word") < last, F.lit(-1).cast("long")).otherwise(F.lit(-1 if rest == 63 else (1 << rest + 1) - 1).cast("long"))
    word, bit = F.floor(F.col("no") / 64).alias("word"), F.pmod(F.col("no"), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)

    named = placed.join(numbers, "geneID", "left").select("cell", _bucket("x", side).alias("sx"), _bucket("y", side).alias("sy"), "x", "y", F.coalesce("no", F.lit(-1).cast("long")).alias("no"), F.when(F.col("no").isNull(), F.col("kind").bitwiseAND(POINT)).otherwise(F.col("kind")).alias("kind"))
    named = named.where(" AND ".join(f"{c} IS NOT NULL" for c in (*square, "x", "y")))  # no others meet a centre
    own = named.repartition(parts, *square).groupBy(*square, "x", "y", "no").agg(F.bit_or("kind").alias("kind"))
    # Tests of the kind alone, and nulls that are gone already, aren't pushed below the shuffle of own, so its readers can share it.
    is_point, is_centre = F.col("kind").bitwiseAND(POINT) > 0, F.col("kind").bitwiseAND(CENTRE) > 0
    of_gene = own.groupBy(*square, "no").agg(F.count_if(is_point).alias("n"), F.max(is_centre).alias("held"))
    squares = of_gene.groupBy(*square, word).agg(F.bit_or(F.when(F.col("held"), one).otherwise(F.lit(0).cast("long"))).alias("bits"), F.sum("n").alias("n"))
    squares = sinks.staged(squares, sinks.shared_path(spark, "squares"))

    # Which genes are settled for a square and which are open, by radius.
    inside = lambda c: F.floor(F.col(c) / wide)
    searched = squares.where("n > 0").select(*square).distinct().withColumns({"bx": inside("sx"), "by": inside("sy")})
    holding = squares.where("bits <> 0").select("cell", F.col("sx").alias("tx"), F.col("sy").alias("ty"), "word", "bits")
    for b, t in (("bx", "tx"), ("by", "ty")):
        holding = holding.withColumn(b, F.explode(F.sequence(F.floor((F.col(t) - steps) / wide), F.floor((F.col(t) + steps) / wide))))
    apart = [F.abs(F.col(f"s{a}") - F.col(f"t{a}")) for a in "xy"]
    furthest = sum(((d + 1.0) * (d + 1.0) for d in apart[1:]), (apart[0] + 1.0) * (apart[0] + 1.0))
    gaps = [F.greatest(d - 1.0, F.lit(0.0)) for d in apart]
    nearest = gaps[0] * gaps[0] + gaps[1] * gaps[1]
    none = F.lit(0).cast("long")
    met_squares = searched.repartition(parts, *bucket).join(holding.repartition(parts, *bucket), bucket).where(nearest <= reached_steps[-1])
    verdicts = met_squares.groupBy(*bucket, *square[1:], "word").agg(
        *[F.bit_or(F.when(furthest <= within_steps[i], F.col("bits")).otherwise(none)).alias(f"in{i}") for i in each],
        *[F.bit_or(F.when(nearest <= reached_steps[i], F.col("bits")).otherwise(none)).alias(f"at{i}") for i in each],
    )
    verdicts = verdicts.select(*bucket, *square[1:], "word", *[f"in{i}" for i in each], *[F.col(f"at{i}").bitwiseAND(F.bitwise_not(f"in{i}")).alias(f"open{i}") for i in each])
    verdicts = sinks.staged(verdicts, sinks.shared_path(spark, "verdicts"))
    any_of = lambda names: " OR ".join(f"{c} <> 0" for c in names)

    # Settled genes, or, place 64 standing for all, those that are not.
    most = [F.bit_count(f"in{i}") * 2 > F.bit_count(every) for i in each]
    fewer = verdicts.where(any_of(f"in{i}" for i in each)).select(
        *square, "word", *[F.when(most[i], 1).otherwise(0).alias(f"all{i}") for i in each],
        *[F.when(most[i], every.bitwiseAND(F.bitwise_not(f"in{i}"))).otherwise(F.col(f"in{i}")).alias(f"in{i}") for i in each],
    )
    told = lambda i: F.when(F.col("bit") == 64, F.col(f"all{i}")).otherwise(F.getbit(f"in{i}", F.least("bit", F.lit(63))).cast("int") * (1 - 2 * F.col(f"all{i}")))
    places = lambda count: F.explode(F.array(*[F.lit(k) for k in range(count)])).alias("bit")
    signed = fewer.repartition(parts, *square).select("*", places(65)).select(*square, "word", "bit", *[told(i).alias(f"v{i}") for i in each]).where(any_of(f"v{i}" for i in each))
    settled = signed.join(of_gene.where("n > 0").select(*square, "no", "n"), square).groupBy("word", "bit", "no").agg(*[F.sum(F.col(f"v{i}") * F.col("n")).alias(f"n{i}") for i in each])

    # Open genes: points against centres.
    asked = verdicts.where(any_of(f"open{i}" for i in each)).drop(*[f"in{i}" for i in each])
    wanted = [F.when(nearest <= reached_steps[i], F.col(f"open{i}")).otherwise(none).bitwiseAND(F.col("bits")).alias(f"open{i}") for i in each]
    asked = asked.join(holding, [*bucket, "word"]).select(*theirs, "sx", "sy", "word", *wanted).where(any_of(f"open{i}" for i in each))
    centres = own.where(is_centre).select("cell", F.col("sx").alias("tx"), F.col("sy").alias("ty"), F.col("x").alias("a_x"), F.col("y").alias("a_y"), word.alias("w"), bit.alias("bit"))
    off = [F.greatest(F.col(f"s{a}") * side - F.col(f"a_{a}"), F.col(f"a_{a}") - (F.col(f"s{a}") + 1) * side, F.lit(0.0)) for a in "xy"]
    asks = lambda i: F.when((off[0] * off[0] + off[1] * off[1] <= (radii[i] * (1 + NEAR)) ** 2) & (F.getbit(f"open{i}", "bit") == 1), 1 << i).otherwise(0)
    sought = asked.repartition(parts, *theirs).join(centres, theirs).where("w <= word AND w >= word").select(*square, "word", "bit", "a_x", "a_y", sum((asks(i) for i in each[1:]), asks(0)).alias("asks")).where("asks > 0")
    compared = own.where(is_point).select(*square, "x", "y", "no").join(sought.repartition(parts, *square), square)
    near = measure("radius", "discrete")
    compared = compared.select(*square, "x", "y", "no", "word", "asks", near.alias("near"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit")).alias("one")).where(F.col("near") <= limit_of(radii[-1], "radius"))
    hit = [F.bit_or(F.when((F.col("near") <= limit_of(radii[i], "radius")) & (F.col("asks").bitwiseAND(1 << i) > 0), F.col("one")).otherwise(none)).alias(f"hit{i}") for i in each]
    hits = compared.groupBy(*square, "x", "y", "no", "word").agg(*hit).where(any_of(f"hit{i}" for i in each))
    either = reduce(lambda a, b: a.bitwiseOR(b), [F.col(f"hit{i}") for i in each])
    beside = hits.select("no", "word", *[f"hit{i}" for i in each], either.alias("either"), places(64)).where(F.getbit("either", "bit") == 1).groupBy("word", "bit", "no").agg(*[F.sum(F.getbit(f"hit{i}", "bit").cast("long")).alias(f"n{i}") for i in each])

    sums = sinks.staged(settled.unionByName(beside), sinks.shared_path(spark, "sums"))
    of_all = sums.where("bit = 64").drop("bit").select("*", places(64)).where(F.getbit(every, "bit") == 1)
    whole = sums.where("bit < 64").unionByName(of_all).groupBy("word", "bit", "no").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in each])
    first = numbers.select(F.col("no").alias("a_no"), F.col("geneID").alias("A"))
    found = whole.withColumn("a_no", F.col("word") * 64 + F.col("bit")).join(first, "a_no").join(numbers, "no", "left")
    return sinks.staged(found.select("A", "geneID", *[f"n{i}" for i in each]), sinks.shared_path(spark, "gene-sums"))


def within(near: DataFrame, reach: float, metric: str = "radius") -> DataFrame:
    """near for a smaller reach: several radii need one join only, at the largest."""
    return near.where(F.col("near") <= limit_of(reach, metric))
