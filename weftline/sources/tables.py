"""Reading files into panels: text, parquet, and single-file matrix formats."""

from __future__ import annotations

import pathlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.blocks import positions, rolling
from weftline.operators import clean
from weftline.panel import Panel, channel_names, finite
from weftline.session import staged

SUPPORTED = (".csv", ".xlsx", ".parquet", ".mat", ".h5", ".hdf5")


def input_files(folder: str, recursive: bool = False) -> list[str]:
    """Supported files of a folder in name order."""
    walk = pathlib.Path(folder).rglob("*") if recursive else pathlib.Path(folder).glob("*")
    return sorted(str(p) for p in walk if p.is_file() and p.suffix.lower() in SUPPORTED)


def number(c: Column) -> Column:
    """Text to double; anything unreadable, NaN or infinite is missing."""
    return finite(c.try_cast("double"))


def _is_number(text: str | None) -> bool:
    try:
        float(text)
    except (TypeError, ValueError):
        return False
    return True


def mostly_numeric(row: Sequence[str | None], share: float = 0.8) -> bool:
    known = [v for v in row if v is not None and str(v).strip()]
    return bool(known) and sum(_is_number(v) for v in known) / len(known) >= share


def has_header(first: Sequence[str | None], second: Sequence[str | None] | None) -> bool:
    return second is not None and not mostly_numeric(first) and mostly_numeric(second)


def numbered(df: DataFrame, out: str = "_row") -> DataFrame:
    """Dense row numbers of a file scan: by file name, place in the file, and row there.

    Spark deals splits out by size, so neither partitions nor their numbers follow the files.
    """
    split = ["_file", "_start"]
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    marked = staged(df.select("*", *place))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    counts = marked.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(*split, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(*split).orderBy("_id"))
    return marked.withColumn("_rn", local).join(offsets, split).withColumn(out, F.col("_off") + F.col("_rn") - 1).drop(*split, "_id", "_rn", "_off")


def split_cells(raw: DataFrame) -> DataFrame:
    """Undo 'a whole row in one cell': split the one filled column at commas, semicolons or tabs."""
    cols, kept = [c for c in raw.columns if c != "_row"], [c for c in raw.columns if c == "_row"]
    marks = F.lit("[,;\t]")
    stats = raw.agg(
        *[F.avg(F.col(c).isNotNull().cast("double")).alias(f"f{i}") for i, c in enumerate(cols)],
        *[F.avg(F.coalesce(F.col(c).rlike("[,;\t]"), F.lit(False)).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.max(F.size(F.split(F.col(c), "[,;\t]"))).alias(f"w{i}") for i, c in enumerate(cols)],
    ).first()
    filled, marked = [stats[f"f{i}"] or 0.0 for i in range(len(cols))], [stats[f"s{i}"] or 0.0 for i in range(len(cols))]
    pick = None
    if len(cols) == 1 or (filled[0] >= 0.8 and all(f <= 0.05 for f in filled[1:])):
        pick = 0 if marked[0] > 0 else None
    if pick is None and max(marked) >= 0.8 and len(cols) > 1:
        pick = marked.index(max(marked))
    if pick is None:
        return raw
    width = int(stats[f"w{pick}"])
    parts = F.split(F.col(cols[pick]), marks)
    return raw.select(*kept, *[F.get(parts, F.lit(i)).alias(f"_c{i}") for i in range(width)])


def read_csv(spark: SparkSession, path: str, header: str = "auto") -> DataFrame:
    """Text columns in file order with ``_row``; header is auto, yes or no."""
    return _titled(split_cells(numbered(spark.read.csv(path, header=False, inferSchema=False))), header)


def _titled(df: DataFrame, header: str) -> DataFrame:
    cols = [c for c in df.columns if c != "_row"]
    top = [list(r)[:-1] for r in df.filter("_row < 2").orderBy("_row").select(*cols, "_row").collect()]
    titled = header == "yes" or (header == "auto" and len(top) > 1 and has_header(top[0], top[1]))
    if not titled:
        return df.select("_row", *[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(cols)])
    seen: dict[str, int] = {}
    names = []
    for i, v in enumerate(top[0]):
        name = str(v).strip() if v is not None and str(v).strip() else f"c{i + 1}"
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}.{seen[name] - 1}")
    body = df.filter("_row > 0").withColumn("_row", F.col("_row") - 1)
    return body.select("_row", *[F.col(c).alias(n) for c, n in zip(cols, names)])


def read_table(spark: SparkSession, path: str, header: str = "auto") -> DataFrame:
    """Raw columns and ``_row`` by file type."""
    kind = pathlib.Path(path).suffix.lower()
    if kind == ".parquet" or pathlib.Path(path).is_dir():
        return numbered(spark.read.parquet(path))
    if kind == ".csv":
        return read_csv(spark, path, header)
    from weftline.sources import binary

    cells = binary.read_cells(spark, path)
    if kind == ".xlsx":
        return _titled(split_wide(cells), header)
    return split_wide(cells)


def split_wide(cells: DataFrame) -> DataFrame:
    """``row, values`` arrays to one column per slot."""
    width = cells.agg(F.max(F.size("values"))).first()[0] or 0
    cols = [F.get("values", F.lit(i)).alias(f"c{i + 1}") for i in range(width)]
    return cells.select(F.col("row").alias("_row"), *cols)


# -- time columns, grids -----------------------------------------------------------------------


def time_like(df: DataFrame, column: str, order: str = "_row") -> bool:
    """A column of increasing time stamps or strictly increasing numbers.

    Numbers must rise throughout: a varying data column is not a clock.
    """
    c = F.col(f"`{column}`")
    text = c.cast("string")
    num, ts = text.try_cast("double"), F.when(text.try_cast("double").isNull(), F.try_to_timestamp(text))
    d = df.select(F.col(order).alias("o"), num.alias("n"), ts.cast("double").alias("s"))
    r = rolling(d, [], "o", lambda w: {"dn": F.col("n") - F.lag("n").over(w), "ds": F.col("s") - F.lag("s").over(w)}, before=1)
    s = r.agg(
        F.avg(F.col("n").isNotNull().cast("double")).alias("nums"),
        F.avg(F.col("s").isNotNull().cast("double")).alias("stamps"),
        F.min("dn").alias("dn"),
        F.min("ds").alias("ds"),
    ).first()
    if (s.stamps or 0) >= 0.9:
        return s.ds is not None and s.ds >= 0
    return (s.nums or 0) >= 0.95 and s.dn is not None and s.dn > 0


def is_grid(columns: Sequence[str]) -> bool:
    lower = {c.strip().lower() for c in columns}
    return {"x", "y", "z"} <= lower and len([c for c in columns if c.strip().lower() not in ("x", "y", "z", "_row")]) >= 2


def _time_order(columns: list[str]) -> list[str]:
    def num(c: str) -> int | None:
        s = c.strip().lower()
        s = s[1:] if s.startswith("t") else s
        return int(s) if s.isdigit() else None

    keys = [num(c) for c in columns]
    return columns if None in keys else [c for _, c in sorted(zip(keys, columns))]


def grid_to_long(df: DataFrame, limit: int | None = None, by: str = "first", seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """Rows ``x, y, z, t0..tN`` to (long panel, coordinates); a limit acts on rows before unpivoting."""
    at = {c.strip().lower(): c for c in df.columns if c.strip().lower() in ("x", "y", "z")}
    times = _time_order([c for c in df.columns if c not in at.values() and c != "_row"])
    values = F.array(*[number(F.col(f"`{c}`")) for c in times])
    xyz = [number(F.col(f"`{at[k]}`")).cast("int").alias(k) for k in "xyz"]
    g = df.select("_row", *xyz, values.alias("v"))
    if limit is not None:
        mean = F.aggregate(F.filter("v", lambda a: a.isNotNull()), F.lit(0.0), lambda s, a: s + a) / F.size(F.filter("v", lambda a: a.isNotNull()))
        var = F.aggregate(F.filter("v", lambda a: a.isNotNull()), F.lit(0.0), lambda s, a: s + (a - mean) * (a - mean))
        order = {"variance": F.desc(var), "random": F.xxhash64("_row", F.lit(seed))}.get(by, F.asc("_row"))
        g = positions(g.orderBy(order, "_row").limit(limit), [], "_row", "_i")
    else:
        g = g.withColumn("_i", F.col("_row"))
    name = F.format_string("v%04d_x%d_y%d_z%d", F.col("_i"), F.col("x"), F.col("y"), F.col("z"))
    g = g.withColumn("channel", name)
    same = g.groupBy("x", "y", "z").agg((F.count(F.lit(1)) > 1).cast("int").alias("coord_duplicate"))
    coords = g.select("channel", "x", "y", "z").join(same, ["x", "y", "z"]).select("channel", "x", "y", "z", "coord_duplicate")
    long = g.select("channel", F.posexplode("v").alias("t", "value")).select(F.col("t").cast("bigint").alias("t"), "channel", "value")
    return long, coords


# -- tidy --------------------------------------------------------------------------------------------


def tidy(
    df: DataFrame, time_col: str = "auto", transpose: str = "no", min_valid: float = 0.2, start: int = 0, end: int | None = None,
    stride: int = 1, limit: int | None = None, by: str = "first", seed: int = 13,
) -> tuple[DataFrame, DataFrame | None]:
    """Raw columns (with ``_row``) to a clean long panel and, for grids, coordinates.

    Order: grid or matrix, drop the time column, numbers, drop sparse channels, transpose if wider
    than long, slice time, limit channels, drop empty rows.
    """
    cols = [c for c in df.columns if c != "_row"]
    coords = None
    if is_grid(cols):
        long, coords = grid_to_long(df, limit, by, seed)
        limit = None
    else:
        if time_col not in ("auto", "none") and time_col in cols:
            cols.remove(time_col)
        elif time_col == "auto" and len(cols) > 1 and time_like(df, cols[0]):
            cols = cols[1:]
        frame = df.select(F.col("_row").cast("bigint").alias("t"), *[number(F.col(f"`{c}`").cast("string")).alias(c) for c in cols])
        long = Panel(frame, tuple(cols)).long()
        if transpose == "yes" or (transpose == "auto" and df.count() < len(cols)):
            rank = {c: i for i, c in enumerate(cols)}
            at = F.create_map(*[x for c, i in rank.items() for x in (F.lit(c), F.lit(i))])
            long = long.select(at[F.col("channel")].cast("bigint").alias("t"), F.format_string("c%d", F.col("t") + 1).alias("channel"), "value")
    long = clean.drop_sparse_channels(clean.drop_empty_channels(long), min_valid)
    if start or end is not None or stride != 1:
        long = clean.time_slice(long, start, end, stride)
    if limit is not None:
        long = clean.limit_channels(long, limit, by, seed)
    long = clean.drop_empty_rows(long)
    return long, coords


def load_panel(spark: SparkSession, path: str, header: str = "auto", **args) -> Panel:
    long, _ = tidy(read_table(spark, path, header), **args)
    long = staged(long)
    times = positions(long.select("t").distinct(), [], "t", "_t")
    long = long.join(times, "t").select(F.col("_t").alias("t"), "channel", "value")
    return Panel.from_long(long, channel_names(long, "channel"))
