"""Files that other programs read: CSV with a mark and a header in every file, one JSON object a file, and its splittable reader.

All are written as lines by Spark's text sink, so that its commit protocol holds: a failed or repeated task leaves no file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.ordering import numbered, numbered_within
from .staging import staged

C = F.col
#: Tells spreadsheet programs that a file is UTF-8.
MARK = "\ufeff"
#: Rows of a file; a larger group goes on in the next file.
FILE_ROWS = 1_000_000
EXPORTED = ["id", "sku", "name_zh", "name_en", "category", "price_rmb", "price_usd", "moq", "image_path", "source_file"]
CSV_OPTIONS = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def csv_lines(columns: list[str], first: Column, mark: bool = True) -> Column:
    """A row's line, behind the header if the row is the first of its file."""
    header = F.lit((MARK if mark else "") + ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n') else c for c in columns))
    line = F.to_csv(F.struct(*[C(f"`{c}`").cast("string").alias(f"c{i}") for i, c in enumerate(columns)]), CSV_OPTIONS)
    return F.explode(F.when(first, F.array(header, line)).otherwise(F.array(line)))


def write_csv_files(df: DataFrame, folder: str, columns: list[str], order: list[str], group: str | None = None, *, rows: int = FILE_ROWS, mark: bool = True) -> None:
    """df's columns as CSV in the given order, which must tell rows apart: folder/<group>=<value>/file_no=<n>/, each a file of
    `rows` rows at most that begins with mark and header. A hot group is many files, and many tasks' work. An empty df
    writes one file with the header alone."""
    named = [*([group] if group else []), "file_no"]
    placed = numbered_within(df, group, *order) if group else numbered(df, *order)
    placed = placed.withColumns({"file_no": F.floor((C("place") - 1) / rows), "__first": (C("place") - 1) % rows == 0})
    placed = placed.repartition(*named).sortWithinPartitions(*named, "place")
    lines = placed.select(*named, csv_lines(columns, C("__first"), mark).alias("value"))
    if df.isEmpty():
        lines = df.sparkSession.range(1).select(F.lit(0).alias("file_no"), F.lit((MARK if mark else "") + ",".join(columns)).alias("value"))
        named = ["file_no"]
    lines.write.mode("overwrite").partitionBy(*named).text(folder)


def export_csv(df: DataFrame, folder: str, user: str, category: str | None = None, limit: int = 10_000) -> None:
    """A user's products, of one category if given, in the ten fixed columns: one file, as there are `limit` rows at most."""
    d = df.where(C("user_id") == user)
    d = d.where(C("category") == category) if category else d
    write_csv_files(d.orderBy("id").limit(limit).select(*EXPORTED), folder, EXPORTED, ["id"], rows=limit)


def write_json_objects(df: DataFrame, folder: str, key: str, *, rows: int = FILE_ROWS) -> None:
    """Rows as entries (key: the other columns) of JSON objects, one object a file, an entry a line; keys must differ."""
    placed = numbered(df, key).withColumn("file_no", F.floor((C("place") - 1) / rows))
    last = F.max("place").over(Window.partitionBy("file_no"))
    placed = placed.withColumns({"__first": (C("place") - 1) % rows == 0, "__last": C("place") == last})
    name = F.to_json(F.array(C(key).cast("string")))
    fields = F.to_json(F.struct(*[C(f"`{c}`") for c in df.columns if c != key]))
    entry = F.concat(F.lit("  "), name.substr(F.lit(2), F.length(name) - 2), F.lit(": "), fields, F.when(C("__last"), "").otherwise(","))
    lines = F.explode(F.array_compact(F.array(F.when(C("__first"), "{"), entry, F.when(C("__last"), "}"))))
    placed.repartition("file_no").sortWithinPartitions("file_no", "place").select("file_no", lines.alias("value")).write.mode("overwrite").partitionBy("file_no").text(folder)


def json_entries(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry): the entries of JSON objects at path, each as an object of its own with one key or, where a line holds
    several, with those. A file is read in parts: a line of JSON never ends within a string, so how deep it goes can be
    told from the line itself, and the depth at its start is the sum of those before it, added up by part and then
    within each. An object in one line is one entry."""
    text = spark.read.text(path).select("value", C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    bare = F.regexp_replace("value", r'"(?:[^"\\]|\\.)*"', "")
    opens, closes = F.length(F.regexp_replace(bare, r"[^{\[]", "")), F.length(F.regexp_replace(bare, r"[^}\]]", ""))
    lines = staged(text.where(F.trim("value") != "").withColumn("step", opens - closes), "json-lines")

    def running(d: DataFrame, what: str, out: str) -> DataFrame:
        """d with the sum of `what` over all earlier lines of the file."""
        blocks = d.groupBy("file", "block").agg(F.sum(what).alias("__all"))
        earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(C("file").alias("__f"), C("block").alias("__b"), F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__before"))
        within = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        d = d.join(blocks, (C("file") == C("__f")) & (C("block") == C("__b")))
        return d.withColumn(out, C("__before") + F.coalesce(F.sum(what).over(within), F.lit(0))).drop("__f", "__b", "__before")

    d = running(lines, "step", "depth")
    inner = F.when(C("depth") == 0, F.regexp_replace("value", r"^\s*\{", "")).otherwise(C("value"))
    inner = F.when(C("depth") + C("step") == 0, F.regexp_replace(inner, r"\}\s*$", "")).otherwise(inner)
    d = d.withColumn("inner", F.trim(inner)).where("inner != ''")
    d = d.withColumn("starts", (C("inner").startswith('"') & (C("depth") <= 1)).cast("int"))
    d = running(staged(d, "json-starts"), "starts", "entry").withColumn("entry", C("entry") + C("starts"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "inner"))), lambda x: x["inner"]), "\n")
    return d.groupBy("file", "entry").agg(F.concat(F.lit("{"), F.regexp_replace(body, r",\s*$", ""), F.lit("}")).alias("entry_json")).select("file", C("entry_json").alias("entry"))


def read_json_objects(spark: SparkSession, path: str, product: str = "model string, price double, last_updated string") -> DataFrame:
    """A library kept as JSON objects (key to product) as rows: product_key and the product's fields. Entries that are no
    products are left out."""
    e = json_entries(spark, path).select(F.explode(F.from_json("entry", f"map<string, struct<{product.replace(' ', ':')}>>".replace(",:", ","))).alias("product_key", "p"))
    return e.where("p is not null").select("product_key", "p.*")
