"""Product stores: listings, names, groups, findings, manifests."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.sources.files import safe
from sensorlake.sources.shared import written


def envelope(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_lines, detectors ('01,02,...'), start, stop."""
    detectors = F.array_join(F.sort_array(F.collect_set(F.format_string("%02d", "detector"))), ",")
    return rows.groupBy(*keys).agg(F.max("line").alias("n_lines"), detectors.alias("detectors"), F.min("t").alias("start"), F.max("t").alias("stop"))


def group_key(name: object) -> object:
    """'start|Rorbit' of a product name; 'unknown' for a name outside of the grammar."""
    from sensorlake.functions.names import parse_lenient

    p = parse_lenient(name)
    return F.coalesce(F.concat(p["start"], F.lit("|R"), p["relative_orbit"].cast("string")), F.lit("unknown"))


def comparability(items: DataFrame) -> DataFrame:
    """items: kind, group. How far each can be compared with the engine's own products (kinds that begin with our-)."""
    own = items.where(F.col("kind").startswith("our-")).select("group").distinct().withColumn("_own", F.lit(True))
    x = items.join(own, "group", "left")
    known = F.col("group") != "unknown"
    label = (
        F.when(F.col("kind").startswith("our-") & ~known, "Group A only (placeholder identity)")
        .when(F.col("kind") == "external-l0-public", F.when(F.col("_own"), "same-scene").otherwise("distribution-level only"))
        .when(known, "same acquisition group")
        .otherwise("unknown")
    )
    return x.withColumn("comparable", label).drop("_own")


def foreign(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Their items of a group that none of ours has; none at all while we have no items."""
    some = ours.limit(1).select(F.lit(True).alias("_any"))
    return theirs.join(ours.select("group").distinct(), "group", "left_anti").crossJoin(F.broadcast(some)).drop("_any")


def sync_plan(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Remote rows to fetch: not here, or here with another checksum (column sum)."""
    x = remote.join(local.withColumnRenamed("sum", "_sum"), key, "left")
    return x.withColumn("reason", F.when(F.col("_sum").isNull(), "missing").when(F.col("_sum") != F.col("sum"), "changed")).where("reason IS NOT NULL").drop("_sum")


def verify(listed: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Listed objects with the outcome of their check: missing, unsafe path, size, md5 (only of single-part tags), or ok."""
    x = listed.join(local, key, "left")
    unsafe = F.col("key").rlike(r"(^|/)\.\.(/|$)") | F.col("key").startswith("/")
    single = ~F.col("etag").contains("-")
    outcome = F.when(unsafe, "unsafe").when(F.col("local_size").isNull(), "missing").when(F.col("local_size") != F.col("size"), "size").when(single & (F.col("etag") != F.col("local_md5")), "md5").otherwise("ok")
    return x.withColumn("verify", outcome)


def relative_key(key: Column, strip: str) -> Column:
    """A listed key as a path inside the destination."""
    return F.regexp_replace(F.when(key.startswith(strip), F.substring(key, len(strip) + 1, 1 << 30)).otherwise(key), "^/+", "")


def complete(listed: DataFrame, files: DataFrame, strip: str = "") -> DataFrame:
    """listed (key, size, etag, ...) with path, verify ('md5' or 'size', null if the object is not whole) and error. files: path, length, content of what is
    there. The digest is taken where a file is read, so no content is shuffled. A tag with a dash is of several parts and says nothing of the content.
    An object of no bytes counts as missing, since listings pass over empty files: fetching it again does no harm."""
    there = files.select("path", F.col("length").alias("_length"), F.md5("content").alias("_md5"))
    x = listed.withColumn("path", relative_key(F.col("key"), strip)).join(there, "path", "left")
    checkable = (F.col("etag") != "") & ~F.col("etag").contains("-")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    error = (
        F.when(F.col("path") == "", "empty destination path")
        .when(~safe(F.col("path")), "unsafe path (escapes destination)")
        .when(F.col("_length").isNull(), "missing")
        .when(F.col("_length") != F.col("size"), text("received ", F.col("_length"), " bytes, expected ", F.col("size")))
        .when(checkable & (F.col("_md5") != F.col("etag")), text("MD5 ", F.col("_md5"), " != ETag ", F.col("etag")))
    )
    x = x.withColumn("error", error)
    return x.withColumn("verify", F.when(F.col("error").isNull(), F.when(checkable, "md5").otherwise("size"))).drop("_length", "_md5")


def to_fetch(listed: DataFrame, files: DataFrame, strip: str = "") -> DataFrame:
    """Listed objects that are not whole in the destination and have a place there, with what is wrong: those that are whole are skipped."""
    x = complete(listed, files, strip)
    return x.where(F.col("verify").isNull() & (F.col("path") != "") & safe(F.col("path"))).drop("verify")


def product_attributes(files: DataFrame) -> DataFrame:
    """product, attrs (JSON text), source of the root attributes of each product of files (path, content): .zattrs, else the entry of that name in
    .zmetadata, of folders and of zip archives, where the member nearest to the root counts. A document that cannot be read counts as {}."""
    from sensorlake.sources.telemetry import register

    spark = files.sparkSession
    register(spark)
    view = f"attribute_files_{uuid.uuid4().hex}"
    files.select("path", "content").createOrReplaceTempView(view)
    docs = spark.sql(f"""
        SELECT regexp_extract(path, '^(.*)/[^/]+$', 1) AS product, substring_index(path, '/', -1) AS name, 0 AS depth, cast(content AS string) AS text FROM {view} WHERE path RLIKE '\\.zarr/\\.z(attrs|metadata)$'
        UNION ALL SELECT path, substring_index(m.name, '/', -1), size(split(m.name, '/')), cast(m.content AS string) FROM {view}, LATERAL zip_members(content) m WHERE path LIKE '%.zip' AND m.name RLIKE '\\.z(attrs|metadata)$'""")
    text = F.when(F.try_parse_json("text").isNotNull(), F.col("text"))
    own = F.when(F.col("name") == ".zattrs", text).otherwise(F.get_json_object(text, "$.metadata['.zattrs']"))
    rank = F.struct((F.col("name") != ".zattrs").alias("later"), "depth")
    return docs.groupBy("product").agg(F.min_by(F.struct(F.coalesce(own, F.lit("{}")).alias("attrs"), F.col("name").alias("source")), rank).alias("x")).select("product", "x.attrs", "x.source")


# Parts of keys that may hold a date or a version.
DATE_HINTS = ["creation", "created", "date", "datetime", "valid", "validity", "generation", "processing", "start", "stop", "end", "version", "provenance"]


def leaves(rows: DataFrame, ids: list[str], attrs: str, *, list_items: int | None = None, most: int = 1_000) -> DataFrame:
    """ids, path (dots, and [i] in lists), key, value (text) of every scalar of a metadata tree, however deep it goes: a frontier of objects and
    lists is opened level by level until none is left, so the number of steps is the depth. list_items: only so many items of each list."""
    spark = rows.sparkSession
    frontier = rows.select(*ids, F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(attrs).alias("v"))
    found, steps = [], 0
    while True:
        view = f"frontier_{uuid.uuid4().hex}"
        frontier.createOrReplaceTempView(view)
        names = ", ".join(f"f.`{c}`" for c in ids)
        wanted = "" if list_items is None else f"WHERE e.key IS NOT NULL OR e.pos < {list_items}"
        opened = spark.sql(f"""SELECT {names}, CASE WHEN e.key IS NULL THEN concat(f.path, '[', e.pos, ']') WHEN f.path = '' THEN e.key ELSE concat(f.path, '.', e.key) END AS path,
            coalesce(e.key, f.key) AS key, e.value AS v FROM {view} f, LATERAL variant_explode(f.v) e {wanted}""")
        opened = opened.withColumn("deep", F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
        level = written(opened.select(*ids, "path", "key", F.to_json("v").alias("text"), "deep"), "metadata-level")
        found.append(level.where(~F.col("deep")).select(*ids, "path", "key", F.get_json_object(F.concat(F.lit('{"v":'), "text", F.lit("}")), "$.v").alias("value")))
        frontier = level.where("deep").select(*ids, "path", "key", F.parse_json("text").alias("v"))
        steps += 1
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, found)
        if steps >= most:
            raise RecursionError(f"a metadata tree is deeper than {most} levels")


def date_like(found: DataFrame) -> DataFrame:
    """Leaves whose own key names a date or a version."""
    return found.where(F.lower("key").rlike("|".join(DATE_HINTS)))


def key_paths(rows: DataFrame, ids: list[str], attrs: str, depth: int) -> DataFrame:
    """ids, path, key of every key of a metadata tree down to a depth: one explode a level, all levels from one scan each."""
    level = rows.select(*ids, F.lit("$").alias("path"), F.col(attrs).alias("_node"))
    out = None
    for _ in range(depth):
        keys = F.explode(F.coalesce(F.json_object_keys("_node"), F.array().cast("array<string>")))
        level = level.select(*ids, "path", "_node", keys.alias("key"))
        level = level.select(*ids, F.concat("path", F.lit("."), "key").alias("path"), "key", F.from_json("_node", "map<string,string>")[F.col("key")].alias("_node"))
        found = level.select(*ids, "path", "key")
        out = found if out is None else out.unionByName(found)
        level = level.where(F.col("_node").startswith("{")).select(*ids, "path", "_node")
    return out


def qc_predicates(products: DataFrame) -> DataFrame:
    """products: ring, start, stop, relative_orbit, absolute_orbit, epoch, has_measurements. One boolean column a check; unknown counts as failed."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "Metadata_Content": F.col("start").isNotNull() & F.col("stop").isNotNull() & F.col("relative_orbit").isNotNull(),
        "Geometry_Ring": (F.size("ring") >= 4) & (F.element_at("ring", 1) == F.element_at("ring", -1)),
        "Sensing_Time": (F.length("start") > 0) & (F.length("stop") > 0) & (F.col("start") <= F.col("stop")),
        "ISO_Time": F.col("start").endswith("Z") & F.col("stop").endswith("Z"),
        "Datation_Sync": F.col("epoch") > 0,
        "Time_Correlation": F.col("epoch").isNotNull(),
        "Relative_Orbit": F.col("relative_orbit").between(1, 143),
        "Absolute_Orbit": F.col("absolute_orbit") >= 0,
        "Product_Structure": F.col("has_measurements"),
    }
    return products.withColumns({k: sure(v) for k, v in checks.items()})


QC_CHECKS = ["Metadata_Content", "Geometry_Ring", "Sensing_Time", "ISO_Time", "Datation_Sync", "Time_Correlation", "Relative_Orbit", "Absolute_Orbit", "Product_Structure"]


def qc_report(products: DataFrame) -> DataFrame:
    """Products with checks (name, result) and overall: OK if all pass."""
    x = qc_predicates(products)
    checks = F.array(*[F.struct(F.lit(c).alias("name"), F.when(F.col(c), "pass").otherwise("fail").alias("result")) for c in QC_CHECKS])
    x = x.withColumn("checks", checks)
    return x.withColumn("overall", F.when(F.forall("checks", lambda c: c["result"] == "pass"), "OK").otherwise("KO")).drop(*QC_CHECKS)


# Path rules in order, the first that fits wins: pattern, kind, role, source.
PATH_RULES = [
    (r"(^|/)\.publish-stage/", "staging-zip", "stage", "local"),
    (r"^report/", "report", "report", "local"),
    (r"^quicklook/", "quicklook", "quicklook", "local"),
    (r"^l1a_prime/", "our-l1a-prime", "derived", "local"),
    (r"^caldb/(.*/)?S02MSI[DS]CA[^/]*(/|$)", "our-cal-l0", "calibration", "local"),
    (r"^caldb/", "caldb-adf", "calibration", "local"),
    (r"^l0/.*_OC\.zarr(/|$)", "our-l0-oc", "derived", "local"),
    (r"^l0/", "our-l0-canonical", "derived", "local"),
    (r"^inputs/public-data/level-0/(.*/)?S02MSIL0P", "external-l0p-annotation", "reference", "public"),
    (r"^inputs/public-data/level-0/(.*/)?S02MSIL0__", "external-l0-public", "reference", "public"),
    (r"^inputs/(.*/)?PDI_MSI_S2_L1A\.zarr(/|$)", "external-l1a", "input", "public"),
    (r"^inputs/real_l0/.*\.tar$", "external-psd-tar", "reference", "public"),
    (r"^inputs/(?i:.*(gipp|/[^/]*GIP[^/]*$))", "reference-gipp", "reference", "local"),
    (r"^inputs/(?i:.*psf)", "reference-psf", "reference", "local"),
    (r"\.pytest_cache|__pycache__", "ci-scratch", "scratch", "local"),
]


def classify(path: object) -> object:
    """Struct kind, role, source of a path in a store."""
    out = F.struct(F.lit("other").alias("kind"), F.lit("other").alias("role"), F.lit("local").alias("source"))
    for pattern, kind, role, source in reversed(PATH_RULES):
        out = F.when(path.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(source).alias("source"))).otherwise(out)
    return out


def items(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, item, bytes: files (path, size) rolled up to their product; caches are left out, other files kept by their ending."""
    root = F.regexp_replace("path", r"(\.zarr)/.*$", "$1")
    wanted = root.rlike(r"(\.zarr|\.zarr\.zip|\.tar|\.json|\.md|\.zip)$") & ~F.col("path").rlike(r"(^|/)(__pycache__|\.git)/")
    return files.where(wanted).groupBy(*keys, root.alias("item")).agg(F.sum("size").alias("bytes"))


# Candidate layouts of a detector's band, in order.
LAYOUTS = [r"measurements/d(\d+)/([^/]+)/img", r"measurements/DD(\d+)/([^/]+)/l1a_raw_image", r"img/(\d+)/([^/]+)", r"(\d+)/([^/]+)"]


def layouts(files: DataFrame) -> DataFrame:
    """detector, band, layout (the first pattern that a path fits) of paths."""
    fits = [F.when(F.regexp_extract("path", p, 1) != "", F.struct(F.regexp_extract("path", p, 1).cast("int").alias("detector"), F.regexp_extract("path", p, 2).alias("band"), F.lit(i).alias("layout"))) for i, p in enumerate(LAYOUTS, 1)]
    return files.withColumn("_l", F.coalesce(*fits)).where("_l IS NOT NULL").select("path", "_l.*")


def root_attributes(docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, attrs: .zattrs before .zmetadata; an unreadable document counts as {}."""
    rank = F.when(F.col("file") == ".zattrs", 0).otherwise(1)
    text = F.when(F.try_parse_json("text").isNotNull(), F.col("text")).otherwise("{}")
    return docs.groupBy(*keys).agg(F.min_by(text, rank).alias("attrs"))


def listing_pages(pages: DataFrame, text: str) -> DataFrame:
    """key, size, etag, next_token of listing pages in XML; tags in quotes are bared."""
    row = "STRUCT<Key: STRING, Size: BIGINT, ETag: STRING>"
    x = pages.select(F.from_xml(F.col(text), f"NextContinuationToken STRING, Contents ARRAY<{row}>").alias("p"))
    return x.select(F.explode("p.Contents").alias("c"), F.col("p.NextContinuationToken").alias("next_token")).select(F.col("c.Key").alias("key"), F.col("c.Size").alias("size"), F.regexp_replace("c.ETag", '"', "").alias("etag"), "next_token")


def run_report(phases: list[str], metrics: DataFrame) -> DataFrame:
    """All metrics, and a row with missing = true for each phase that has none."""
    p = metrics.sparkSession.createDataFrame([(x,) for x in phases], "phase string")
    seen = metrics.select("phase").distinct().withColumn("_seen", F.lit(True))
    return p.join(seen, "phase", "left").join(metrics, "phase", "left").select("phase", "band", "name", "value", F.col("_seen").isNull().alias("missing"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def finding(rows: DataFrame, name: str, severity: str, evidence: object) -> DataFrame:
    return rows.select(F.lit(name).alias("id"), F.lit(severity).alias("severity"), evidence.alias("evidence"))


def exists_finding(rows: DataFrame, name: str, severity: str, evidence: str) -> DataFrame:
    """One finding if there is any row."""
    return finding(rows.limit(1), name, severity, F.lit(evidence))


def findings(records: DataFrame, reports: DataFrame, *, setting_given: bool) -> DataFrame:
    """All rules over records (path, kind, group, flags, name_orbit, orbit, identity_source) and reports (path, text); a default row where none fires."""
    their, our = records.where("kind = 'external-l0-public'"), records.where("kind LIKE 'our-l0%'")
    rules = [
        finding(records.where("name_orbit IS NOT NULL AND orbit IS NOT NULL AND name_orbit <> orbit"), "orbit-name-stac-mismatch", "HIGH", F.concat(F.col("path"), F.lit(": name R"), F.col("name_orbit").cast("string"), F.lit(" vs STAC R"), F.col("orbit").cast("string"))),
        exists_finding(records.where("kind = 'external-l1a' AND array_contains(flags, 'no_zarr_attrs')"), "pdi-stac-missing", "HIGH", "the main input has no readable attributes"),
        finding(foreign(their, our), "public-l0-different-datatake", "CRITICAL", F.concat(F.col("path"), F.lit(" groups as "), F.col("group"))),
        exists_finding(records.where("kind = 'external-l0p-annotation' AND identity_source = 'none'"), "l0p-annotations-no-stac", "LOW", "annotation products have no properties"),
        exists_finding(records.where("path = '.publish-stage/gipp.zip'").where(F.lit(not setting_given)), "radiometric-vv-gipp-skipped", "MEDIUM", "the payload exists but its setting is unset"),
        exists_finding(reports.where("path = 'report/l0_decode.json' AND get_json_object(text, '$.groups') = '4'"), "l0-decode-empty-group-count", "INFO", "a report counts four groups"),
    ]
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    fired = out.limit(1).select(F.lit(True).alias("_f"))
    none = records.sparkSession.createDataFrame([("inventory-no-blockers", "INFO", "no inconsistency was found")], "id string, severity string, evidence string")
    return out.unionByName(none.join(fired, F.lit(True), "left_anti"))


def structure(files: DataFrame) -> DataFrame:
    """product, detectors, bands, arrays: how many a product holds, from the paths of its files (product/measurements/detector/band/array/...). Bands are told apart without
    regard to case; a product without such files has none of them. Paths are made distinct before they are counted."""
    inside = r"\.zarr/measurements/(d\d{2}|DD\d{2})/([^/]+)/([^/]+)"
    part = lambda i: F.nullif(F.regexp_extract("path", inside, i), F.lit("")).alias("dba"[i - 1])
    x = files.where(F.col("path").contains(".zarr")).select(F.regexp_replace("path", r"(\.zarr)(/.*)?$", "$1").alias("product"), part(1), part(2), part(3)).distinct()
    return x.groupBy("product").agg(F.count_distinct("d").alias("detectors"), F.count_distinct(F.upper("b")).alias("bands"), F.count("d").alias("arrays"))
