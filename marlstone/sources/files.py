"""Evidence files and knowledge tables: scans, hashes, signatures, place-table readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of evidence images, and leading bytes (hex) of their formats.
SUFFIXES = ("jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "webp", "heic", "heif")
SIGNATURES = (("PNG", "89504E470D0A1A0A"), ("JPEG", "FFD8FF"), ("GIF", "47494638"), ("BMP", "424D"), ("TIFF", "49492A00"), ("TIFF", "4D4D002A"))
FAMILIES = {"JPEG": ("jpg", "jpeg"), "PNG": ("png",), "GIF": ("gif",), "BMP": ("bmp",), "TIFF": ("tif", "tiff"), "WEBP": ("webp",), "HEIC": ("heic", "heif")}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_supported(path: Column) -> Column:
    return suffix(path).isin(*SUFFIXES)


def signature(content: Column) -> Column:
    """Format by the first 32 bytes, 'Unknown' if none fits."""
    head = F.hex(F.substring(content, 1, 32))
    out = None
    for name, start in SIGNATURES:
        fits = head.startswith(start)
        out = F.when(fits, name) if out is None else out.when(fits, name)
    out = out.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    return out.when((F.substring(head, 9, 8) == "66747970") & F.substring(head, 17, 8).isin("68656963", "68656978", "6D696631", "68656966"), "HEIC").otherwise("Unknown")


def signature_status(path: Column, family: Column) -> Column:
    """Matched, Compatible, Mismatch or Unknown, from suffix and signature; the two names of one container are compatible."""
    out = F.when(family == "Unknown", "Unknown")
    for name, suffixes in FAMILIES.items():
        out = out.when((family == name) & suffix(path).isin(*suffixes), F.when(suffix(path) == "heif", "Compatible").otherwise("Matched") if name == "HEIC" else "Matched")
    return out.otherwise("Mismatch")


def format_trust(status: Column, parser: Column) -> Column:
    """How far a file's format can be trusted, from its signature and whether it could be read."""
    fits = status.isin("Matched", "Compatible")
    return F.when(status == "Mismatch", "Conflict").when(parser == "Failed", F.when(fits, "Header-only").otherwise("Weak")).when(fits, "Verified").otherwise("Weak")


def source_type(name: Column, has_exif: Column, software: Column, width: Column, height: Column, parser: Column) -> Column:
    """One of seven classes of a file; the first rule that holds counts."""
    low, end = F.lower(name), suffix(name)
    return (
        F.when(parser == "Failed", "Malformed / Unsupported Asset")
        .when(F.lower(F.coalesce(software, F.lit(""))).rlike("photoshop|lightroom|snapseed|canva|gimp"), "Edited / Exported")
        .when(has_exif & end.isin("jpg", "jpeg", "tif", "tiff", "heic", "heif") & (F.greatest(width, height) >= 1200), "Camera Photo")
        .when(low.contains("screenshot"), "Screenshot")
        .when(low.rlike("whatsapp image|telegram|export"), "Messaging Export")
        .when(end.isin("png", "webp") & ~has_exif, "Screenshot / Export")
        .when(end.isin("gif", "bmp"), "Graphic Asset")
        .otherwise("Unknown")
    )


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence files below a folder: path, name, size, modified, sha256, md5, format and status. Bytes stay in the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_supported(F.col("path")))
    out = files.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), signature(F.col("content")).alias("family"),
    )
    return out.withColumn("signature_status", signature_status(F.col("path"), F.col("family")))


def verify_copies(sources: DataFrame, copies: DataFrame, root: str = "", copy_root: str = "") -> DataFrame:
    """Source files against their copies by path below the two roots: verified, changed or missing."""
    below = lambda start: F.regexp_replace(F.split("path", start.rstrip("/") + "/", 2)[1], "^/+", "") if start else F.col("path")
    left = sources.select(below(root).alias("relative_path"), "name", "sha256")
    right = copies.select(below(copy_root).alias("relative_path"), F.col("sha256").alias("copy_sha256"))
    joined = left.join(right, "relative_path", "left")
    return joined.withColumn("copy_status", F.when(F.col("copy_sha256").isNull(), "missing").when(F.col("sha256") == F.col("copy_sha256"), "verified").otherwise("changed"))


# The 19 columns of a GeoNames table.
GEONAMES = (
    "geonameid long, name string, asciiname string, alternatenames string, latitude double, longitude double, feature_class string, feature_code string, country_code string, cc2 string, "
    "admin1 string, admin2 string, admin3 string, admin4 string, population long, elevation string, dem string, timezone string, modification_date string"
)
ALTERNATE_NAMES = "alternateNameId long, geonameid long, isolanguage string, name string"


def geonames(spark: SparkSession, path: str, least_population: int = 0) -> DataFrame:
    """A GeoNames table; capitals and first- and second-level seats stay whatever their population."""
    rows = spark.read.csv(path, sep="\t", schema=GEONAMES, quote="")
    return rows.where((F.col("population") >= least_population) | F.col("feature_code").isin("PPLC", "PPLA", "PPLA2"))


def alternate_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=ALTERNATE_NAMES, quote="")


def timezones(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(rows.columns[0]).alias("country_code"), F.col(rows.columns[1]).alias("timezone"))


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table with a header whose separator is the most frequent of tab, semicolon and comma in its first line."""
    first = spark.read.text(path).first()
    line = first[0] if first else ""
    return spark.read.csv(path, header=True, sep=max("\t;,", key=line.count))


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Points of a GeoJSON collection: name, latitude, longitude and the other properties as JSON."""
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:array<double>>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return rows.where("f.geometry.type = 'Point'").select(F.col("f.properties")["name"].alias("name"), F.get(at, 1).alias("latitude"), F.get(at, 0).alias("longitude"), F.to_json("f.properties").alias("properties"))


def snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON snapshot; where it is missing or damaged, its '.bak'."""
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    for candidate in (path, f"{path}.bak"):
        try:
            df = spark.read.schema(schema).option("mode", "FAILFAST").json(candidate, multiLine=True)
            df.limit(1).collect()
            return df
        except (Py4JJavaError, PySparkException):
            if candidate.endswith(".bak"):
                raise
    raise AssertionError


def failures(spark: SparkSession, path: str, most: int = 80) -> DataFrame:
    """The last failures of a JSON-lines log, malformed lines left out."""
    schema = "time string, context string, message string, evidence_id string, operation string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("time is not null").orderBy(F.desc("time")).limit(most)


#: Keys of a place in JSON, in the order in which they are tried.
PLACE_KEYS = {"name": ("name", "asciiname", "place_name", "title"), "country": ("country", "country_name"), "city": ("city", "town"), "latitude": ("latitude", "lat"), "longitude": ("longitude", "lon", "lng"), "level": ("level", "type"), "population": ("population", "pop")}


def _first_of(row: Column, keys: tuple[str, ...]) -> Column:
    """The first key of a JSON text that has a value other than blanks."""
    return F.coalesce(*(F.nullif(F.trim(F.get_json_object(row, f"$.{k}")), F.lit("")) for k in keys))


def json_places(spark: SparkSession, path: str) -> DataFrame:
    """Places of a JSON payload: a list, an object with ``places`` or ``features``, one object, or one object a line; rows without a name are left out.

    A file is read as a whole text, so each payload should fit a row; JSON lines are split inside it.
    """
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    array = "array<string>"
    lists = F.coalesce(F.from_json(F.get_json_object("t", "$.places"), array), F.from_json(F.get_json_object("t", "$.features"), array), F.when(F.col("t").startswith("["), F.from_json("t", array)))
    lines = F.filter(F.split("t", r"\r?\n"), lambda x: F.trim(x).startswith("{") & F.get_json_object(x, "$").isNotNull())
    single = F.when(F.get_json_object("t", "$").isNotNull() & F.col("t").startswith("{") & (F.size(lines) <= 1), F.array("t"))
    rows = whole.select(F.explode(F.coalesce(lists, single, lines)).alias("row"))
    point = F.from_json(F.get_json_object("row", "$.geometry.coordinates"), "array<double>")
    inner = F.coalesce(F.get_json_object("row", "$.properties"), F.col("row"))
    out = rows.select(inner.alias("row"), point.alias("point")).select(*(_first_of(F.col("row"), keys).alias(c) for c, keys in PLACE_KEYS.items()), F.from_json(F.get_json_object("row", "$.aliases"), array).alias("aliases"), "point")
    out = out.withColumns({"latitude": F.coalesce(F.col("latitude").try_cast("double"), F.get("point", F.lit(1))), "longitude": F.coalesce(F.col("longitude").try_cast("double"), F.get("point", F.lit(0))), "population": F.col("population").try_cast("long")})
    return out.drop("point").where("name is not null")


#: Auxiliary tables of a place dump, by what their names hold; they are no places.
AUXILIARY = ("alternatenames", "countryinfo", "admin1codes", "admin2codes", "timezones", "featurecodes", "readme")


def place_kind(name: Column) -> Column:
    """geonames, json, delimited, zip, auxiliary or other: which reader a file of a place dump needs."""
    low, end = F.lower(name), suffix(name)
    auxiliary = low.rlike("|".join(AUXILIARY))
    return F.when(auxiliary, "auxiliary").when(end.isin("json", "geojson", "jsonl"), "json").when(end == "zip", "zip").when(end.isin("csv", "tsv"), "delimited").when(end == "txt", "geonames").otherwise("other")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, content) of the member that each zip file is read for: that named like the file, else the one of the shortest name. Members that would leave the folder are never taken."""
    import io
    import zipfile

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                safe = [m for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith((".txt", ".csv", ".tsv", ".json")) and not m.filename.startswith(("/", "\\")) and ".." not in m.filename.replace("\\", "/").split("/")]
                stem = file.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
                named = [m for m in safe if m.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() == stem]
                for m in sorted(named or safe, key=lambda m: (len(m.filename), m.filename))[:1]:
                    rows.append((file, m.filename, m.file_size, z.read(m)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())], names=["path", "member", "size", "content"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, member string, size long, content binary")


def countries(spark: SparkSession, path: str) -> DataFrame:
    """country_code, iso3, country, capital, continent of a country table; lines of comments are left out."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="")
    return rows.select(F.col("_c0").alias("country_code"), F.col("_c1").alias("iso3"), F.col("_c4").alias("country"), F.col("_c5").alias("capital"), F.col("_c8").alias("continent"))


def admin_codes(spark: SparkSession, path: str) -> DataFrame:
    """country_code, code (the rest of the key), name of a table of first- or second-level divisions."""
    rows = spark.read.csv(path, sep="\t", quote="")
    key = F.split("_c0", "[.]", 2)
    return rows.select(key[0].alias("country_code"), key[1].alias("code"), F.col("_c1").alias("name"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, key, value) of a JSON object of objects; keys that begin with an underscore are about the set itself. The last of repeated names counts."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m")).select(F.explode("m").alias("file_name", "body"))
    rows = rows.where(~F.col("file_name").startswith("_")).select("file_name", F.explode(F.from_json("body", "map<string,string>")).alias("key", "value"))
    return rows.where(~F.col("key").startswith("_"))
