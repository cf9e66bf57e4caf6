"""Carbon accounting: usage lines to records, intensities, best regions and interval reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from docquery.functions.text import bound

# Watts of an idle and a busy unit, its share of use, megabytes of a unit, and the regions' other names.
WATTS = 0.74 + 0.5 * (3.5 - 0.74)
UNIT_MB = 1792
CLOUD_REGIONS = {"us-east-1": "eastus"}
FALLBACK_ZONES = {"norway": "NO"}
DEFAULT_REGION = "eastus"

# Labels of a usage line's texts and numbers; headers have any prefix.
TEXTS = {
    "request_id": "RequestId:",
    "function": "Function:",
    "path": "Path:",
    "resource": "Resource:",
    "organization": "Organization:",
    "repository": "Repository:",
    "service": r"X-\w+-SERVICE:",
    "userId": "UserId:",
    "username": "Username:",
    "region": r"X-\w+-REGION:",
    "regions": r"X-\w+-REGIONS:",
    "intensities": r"X-\w+-INTENSITIES:",
}
NUMBERS = {
    "duration": r"(?<!Billed )(?<!Init )\bDuration:",
    "billed_duration": "Billed Duration:",
    "init_duration": "Init Duration:",
    "memory_size": r"\bMemory Size:",
    "max_memory_used": "Max Memory Used:",
}


#: All labels of numbers with their values; what no label begins with is passed at once.
_NUMBER_LABELS = rf"(?=[BDIM])(?:{'|'.join(NUMBERS.values())})\s+[0-9.]+"


def _text(label: str) -> Column:
    """What follows a text's label where it is a word. The pattern looks back from the label's own characters, so that it fails fast elsewhere."""
    part = label.removeprefix(r"X-\w+")
    pattern = rf"{part}(?<!\S{part})" if part == label else rf"X-(?<!\SX-)\w+{part}"
    return F.nullif(F.when(F.col("message").contains(part), F.regexp_extract("message", rf"{pattern}\s+(?:null(?!\S)|(\S+))", 1)), F.lit(""))


def parsed_lines(lines: DataFrame, keep: tuple[str, ...] = ("batch_id", "line_no")) -> DataFrame:
    """Labelled values of each usage line (batch_id, line_no, message), the first of each; null, the word, is no value (K1).

    A text's label is a word, and its value the next one, which can be a label itself. Numbers are found by one pattern, each
    with its label. Patterns are only tried on lines that have their labels, and only those of columns that are used.
    """
    has = reduce(Column.__or__, [F.col("message").contains(x) for x in ("Duration:", "Memory Size:", "Max Memory Used:")])
    # The word null, then each label and its value: a label that is not there is at place 0, and so is the null.
    found = F.array_join(F.regexp_extract_all("message", F.lit(_NUMBER_LABELS), F.lit(0)), "|")
    pairs = F.when(has, F.split(F.concat(F.lit("null|"), F.replace(found, F.lit(":"), F.lit("|"))), r"\|"))
    names = F.array(*[F.lit(x.split(r"\b")[-1].removesuffix(":")) for x in NUMBERS.values()])
    beside = bound(pairs, lambda p: F.transform(names, lambda x: F.get(p, F.array_position(p, x).cast("int"))))
    numbers = F.transform(beside, lambda x: F.round(F.when(x != "null", x).try_cast("double")).cast("int"))
    rows = lines.select(*keep, *[_text(x).alias(k) for k, x in TEXTS.items()], numbers.alias("_n"))
    return rows.select(*keep, *TEXTS, *[F.get("_n", F.lit(i)).alias(k) for i, k in enumerate(NUMBERS)])


def records(lines: DataFrame) -> DataFrame:
    """One record a batch: of each label the last line's value (K1-K3)."""
    return folded(parsed_lines(lines), ["batch_id"])


def folded(parsed: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Parsed lines of one key as a record: of each label the last line's value, routed if a region was named."""
    lasts = [F.max_by(n, F.when(F.col(n).isNotNull(), F.col("line_no"))).alias(n) for n in [*TEXTS, *NUMBERS]]
    return parsed.groupBy(*keys).agg(*lasts).withColumns({"routed": F.col("region").isNotNull(), "grid": header_map(F.col("regions"), F.col("intensities"))}).drop("regions", "intensities")


def header_map(regions: Column, intensities: Column) -> Column:
    """Regions to rounded intensities, zipped by place; the first of a repeated region counts (K2)."""

    def made(names, values):
        n = F.least(F.size(names), F.size(values))
        known = F.array_distinct(F.slice(names, F.lit(1), F.greatest(n, F.lit(0))))
        rated = F.transform(known, lambda x: F.element_at(values, F.array_position(names, x).cast("int")))
        return F.when(n > 0, F.coalesce(F.map_from_arrays(known, rated), F.create_map().cast("map<string,int>")))

    rounded = F.transform(F.split(intensities, ","), lambda x: F.round(F.coalesce(x.try_cast("double"), F.lit(0.0))).cast("int"))
    return bound(F.split(regions, ","), lambda names: bound(rounded, lambda values: made(names, values)))


def with_region(df: DataFrame, cloud_region: str) -> DataFrame:
    """The region, else that of the cloud region by its other name (K3)."""
    names = F.create_map(*[F.lit(x) for pair in CLOUD_REGIONS.items() for x in pair])
    return df.withColumn("region", F.coalesce("region", names[F.col(cloud_region)], F.col(cloud_region)))


def electricity(duration_ms: Column, memory_mb: Column, wrap_minutes: bool = True) -> Column:
    """Watt-hours of a call, in whole seconds; as in the original whole minutes vanish unless wrap_minutes is False (K4)."""
    seconds = F.floor(duration_ms / 1000)
    return WATTS * (seconds % 60 if wrap_minutes else seconds) / 3600 * memory_mb / UNIT_MB


def with_carbon(df: DataFrame, intensity: str = "intensity", wrap_minutes: bool = True) -> DataFrame:
    df = df.withColumn("electricity", electricity(F.col("duration"), F.col("memory_size"), wrap_minutes))
    return df.withColumn("carbon", F.col("electricity") * F.col(intensity))


def actual_and_others(df: DataFrame, grid: str = "grid") -> DataFrame:
    """Each record for its own region, called, and once for every other region of its grid map (K5): one pass."""
    own = F.struct(F.col("region").alias("region"), F.coalesce(F.col(grid)[F.col("region")], F.lit(0)).alias("intensity"), F.lit(True).alias("called"))
    rest = F.transform(F.filter(F.map_entries(F.coalesce(grid, F.create_map().cast("map<string,int>"))), lambda e: e["key"] != F.coalesce("region", F.lit(""))), lambda e: F.struct(e["key"].alias("region"), e["value"].alias("intensity"), F.lit(False).alias("called")))
    others = [c for c in df.columns if c not in (grid, "region")]
    return with_carbon(df.select(*others, F.explode(F.concat(F.array(own), rest)).alias("_x")).select(*others, "_x.*"))


def glob_regex(pattern: Column) -> Column:
    """A glob as a regular expression: ** any text, * any text without a slash, ? one character."""
    quoted = F.regexp_replace(pattern, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(F.replace(quoted, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def best_regions(services: DataFrame, calls: DataFrame, grid: DataFrame, default: str = DEFAULT_REGION) -> DataFrame:
    """(service, path, region) of least intensity among the regions that serve the path (K6).

    services: name, regions (region, paths as globs, none for all); calls: service, path; grid: region, intensity, where
    0 and less count for nothing.
    """
    offers = services.select(F.col("name").alias("service"), F.explode("regions").alias("r")).select("service", F.col("r.region").alias("region"), F.col("r.paths").alias("paths"))
    rated = offers.join(grid.where("intensity > 0"), "region")
    best = F.min(F.struct("intensity", "region"))
    wanted = calls.select("service", "path").distinct()
    # Regions for all paths, and for each glob the best of those that have it: paths never meet the regions themselves.
    anywhere = rated.where(F.size(F.coalesce("paths", F.array().cast("array<string>"))) == 0).groupBy("service").agg(best.alias("anywhere"))
    globs = rated.select("service", "region", "intensity", F.explode("paths").alias("glob")).groupBy("service", "glob").agg(best.alias("best"))
    # A path meets the globs whose literal beginning is its own: an equi-join for each length of a beginning, then the glob.
    globs = globs.withColumn("head", F.regexp_extract("glob", r"^[^*?]*", 0)).withColumn("length", F.length("head"))
    lengths = F.array(*[F.lit(r[0]) for r in globs.select("length").distinct().orderBy("length").collect()]).cast("array<int>")
    heads = wanted.select("service", "path", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))).alias("length")).withColumn("head", F.expr("left(path, length)"))
    met = heads.join(globs, ["service", "length", "head"]).where(F.rlike(F.col("path"), glob_regex(F.col("glob"))))
    here = met.groupBy("service", "path").agg(F.min("best").alias("here"))
    found = wanted.join(here, ["service", "path"], "left").join(anywhere, "service", "left")
    return found.select("service", "path", F.coalesce(F.least("here", "anywhere")["region"], F.lit(default)).alias("region"))


def savings(choices: DataFrame, grid: DataFrame) -> DataFrame:
    """Chosen intensity against the least of the report, and what it says (K7).

    choices: report, region; grid: report, region, intensity. A region that a report has twice counts with its least one.
    """
    grid = grid.groupBy("report", "region").agg(F.min("intensity").alias("intensity"))
    least = grid.where("intensity > 0").groupBy("report").agg(F.min(F.struct("intensity", "region")).alias("b"))
    out = choices.join(grid, ["report", "region"], "left").join(least, "report", "left")
    gap = F.coalesce("intensity", F.lit(0.0)) - F.coalesce("b.intensity", F.lit(0.0))
    return out.select("report", "region", "intensity", F.col("b.region").alias("best_region"), gap.alias("difference"), F.when(gap > 0, "improvable").when(gap == 0, "best").otherwise("unknown").alias("message"))


def interval_report(regions: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """A row for each region and interval: the last primary rating, else the fallback zone's, else 0 (K8, K9).

    regions: region; primary: region, ts, rating; fallback: zone, ts, rating. Intervals of five minutes that either has,
    so that an outage of the primary still has its rows.
    """
    zones = F.create_map(*[F.lit(x) for pair in FALLBACK_ZONES.items() for x in pair])
    window = F.window("ts", "5 minutes")
    found = primary.groupBy(window.alias("w"), "region").agg(F.max_by("rating", "ts").alias("first_rating"))
    spare = fallback.groupBy(window.alias("w"), "zone").agg(F.max_by("rating", "ts").alias("spare_rating"))
    names = F.array(*[F.lit(r[0]) for r in regions.select("region").distinct().orderBy("region").collect()])  # a few dozen by nature
    every = found.select("w").unionByName(spare.select("w")).distinct().select("w", F.explode(names).alias("region"))
    out = every.join(found, ["w", "region"], "left").withColumn("zone", zones[F.col("region")]).join(spare, ["w", "zone"], "left")
    return out.select(F.col("w.start").alias("start_date"), F.col("w.end").alias("end_date"), "region", F.coalesce("first_rating", "spare_rating", F.lit(0.0)).alias("rating"))


def report_maps(long: DataFrame) -> DataFrame:
    """Long-form intensities as one map for each interval; regions are few by nature."""
    return long.groupBy("start_date", "end_date").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("region", "rating")))).alias("intensities"))


def report_rows(reports: DataFrame) -> DataFrame:
    """A report's map as rows."""
    return reports.select("start_date", "end_date", F.explode("intensities").alias("region", "rating"))


def current_index(regions: DataFrame, index: DataFrame) -> DataFrame:
    """Grid regions with their latest index (K10): regions: ba, name; index: ba, percent, point_time."""
    last = F.row_number().over(Window.partitionBy("ba").orderBy(F.desc("point_time")))
    return regions.join(index.withColumn("_n", last).where("_n = 1").select("ba", "percent"), "ba", "left")
