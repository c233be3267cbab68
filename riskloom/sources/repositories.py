"""Where the code of a repository lies: monorepos, the folder of its main project, its languages.

Files are summed up by folder first; everything else is read from that table, which grows
with the folders. Repositories are keys, so one pass answers for all of them, and as all
steps are partial aggregates a repository may hold most files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.functions import text as t
from riskloom.shared import materialise

#: Endings of code, names of configuration files, of files at the root of a monorepo, and of folders that hold projects.
CODE = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
CONFIGURATION = (
    "package.json tsconfig.json jsconfig.json next.config.js next.config.ts next.config.mjs vite.config.js vite.config.ts vite.config.mjs nuxt.config.js nuxt.config.ts"
    " svelte.config.js svelte.config.ts astro.config.js astro.config.ts astro.config.mjs remix.config.js remix.config.ts turbo.json nx.json lerna.json rush.json"
).split()
MONOREPO_FILES = ["turbo.json", "nx.json", "lerna.json", "rush.json", "pnpm-workspace.yaml", "pnpm-workspace.yml"]
CONTAINERS = ["apps", "packages", "services", "libs", "lib", "projects", "components", "examples", "samples"]
#: Folders that tell of sources, folders that are not looked at, keys of a manifest that names workspaces.
SOURCE_FOLDERS = ["src", "app", "pages", "server", "api"]
SKIPPED = ["node_modules", "dist", "build", "out", ".git", ".next", "coverage"]
WORKSPACE_KEYS = ["workspaces", "turbo", "nx", "pnpm", "lerna"]
#: A schema's snapshot by its path.
SNAPSHOT = r"^(?:(?:.*/)?datastores/supabase/[^/]+|datastores/supabase|supabase)/schema\.json$"


def inference_paths(files: DataFrame, also_skipped: tuple[str, ...] = ()) -> DataFrame:
    """files(repo, path, ...) with plain paths, without those in folders of build results and without dot files."""
    p = F.col("path")
    p = F.regexp_replace(F.regexp_replace(t.trim(F.regexp_replace(p, r"\\", "/")), r"^\.?/*", ""), "/+$", "")
    skipped = "|".join(x.replace(".", r"\.") for x in [*SKIPPED, *also_skipped])
    return files.withColumn("path", p).where((F.col("path") != "") & ~F.col("path").rlike(rf"(?i)(?:^|/)(?:{skipped})(?:/|$)") & ~F.col("path").rlike(r"(?:^|/)\.[^/]*$"))


def _names_workspaces(content: Column) -> Column:
    """Whether a manifest's text mentions workspaces or has a key of a workspace tool that is not null, false, 0 or empty."""
    held = [F.coalesce(F.get_json_object(content, f"$.{k}"), F.lit("")) for k in WORKSPACE_KEYS]
    return F.coalesce(content.contains('"workspaces"') | content.contains("'workspaces'"), F.lit(False)) | F.greatest(*[(~v.isin("", "0", "false")).cast("int") for v in held]).cast("boolean")


def folder_facts(files: DataFrame, also_skipped: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (repo, folder) of files(repo, path[, content]): what its own files are."""
    content = F.col("content") if "content" in files.columns else F.lit(None).cast("string")
    plain = inference_paths(files, also_skipped).select("repo", "path", F.when(F.col("path") == "package.json", content).alias("content"))
    name, folder = F.substring_index("path", "/", -1), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = plain.withColumns({"folder": folder, "name": name, "parts": parts})
    return rows.groupBy("repo", "folder").agg(
        F.count("*").alias("total"), F.count_if(t.extension(F.col("path")).isin(*CODE)).alias("code"), F.count_if(F.lower("name").isin(*CONFIGURATION)).alias("config"),
        F.bool_or((F.col("folder") == "") & F.col("name").isin(*MONOREPO_FILES)).alias("marked"), F.count_if(F.col("name") == "package.json").alias("manifests"),
        F.bool_or(_names_workspaces(F.col("content"))).alias("workspaces"), F.bool_or(F.lower(F.col("parts")[0]).isin(*CONTAINERS)).alias("contained"), F.min("parts").alias("least"), F.max("parts").alias("greatest"),
    )


def monorepos(folders: DataFrame) -> DataFrame:
    """(repo, monorepo): a monorepo has a file of a workspace tool at its root, or two nested
    manifests beside a root manifest or a folder of projects, or a root manifest that names
    workspaces or stands beside a nested one and a folder of projects."""
    root = F.col("folder") == ""
    facts = folders.groupBy("repo").agg(
        F.bool_or("marked").alias("marked"), F.bool_or(root & (F.col("manifests") > 0)).alias("root"), F.sum(F.when(~root, F.col("manifests")).otherwise(0)).alias("nested"),
        F.bool_or("workspaces").alias("workspaces"), F.bool_or("contained").alias("contained"),
    )
    c = F.col
    return facts.select("repo", (c("marked") | ((c("nested") >= 2) & (c("contained") | c("root"))) | (c("root") & (c("workspaces") | ((c("nested") >= 1) & c("contained"))))).alias("monorepo"))


def _ancestors(folder: str) -> Column:
    """A folder and the folders that hold it, without the root."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def project_candidates(folders: DataFrame) -> DataFrame:
    """(repo, prefix, config, total, code, hints, score) of the folders with configuration files.
    Files count for every candidate above them: folders, not files, meet their ancestors."""
    nested = folders.where("folder <> ''")
    candidates = nested.where("config > 0").select("repo", F.col("folder").alias("prefix"), "config")
    below = nested.select("repo", "folder", "total", "code", F.explode(_ancestors("folder")).alias("prefix")).join(candidates, ["repo", "prefix"])
    rest = F.concat(F.lower(F.substr("folder", F.length("prefix") + 1)), F.lit("/"))
    hinted = F.when(rest.rlike(f"/(?:{'|'.join(SOURCE_FOLDERS)})/"), F.col("total")).otherwise(0)
    stats = below.groupBy("repo", "prefix").agg(F.first("config").alias("config"), F.sum("total").alias("total"), F.sum("code").alias("code"), F.sum(hinted).alias("hints"))
    return stats.withColumn("score", 2 * F.col("code") + F.col("total") + 25 * F.col("config") + 2 * F.least("hints", F.lit(20)))


def _two_best(stats: DataFrame, order: list[Column], keep: list[str]) -> DataFrame:
    """(repo, a, b, n, all_code): the first two of a repository's rows as records, how many there are, and their code."""
    sums = stats.groupBy("repo").agg(F.count("*").alias("n"), F.sum("code").alias("all_code"))
    place = F.row_number().over(W.partitionBy("repo").orderBy(*order))
    first = stats.withColumn("rn__", place).where("rn__ <= 2")
    record = F.struct("prefix", *keep)
    return first.groupBy("repo").agg(F.max(F.when(F.col("rn__") == 1, record)).alias("a"), F.max(F.when(F.col("rn__") == 2, record)).alias("b")).join(sums, "repo")


def configured_project(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, prefix) of repositories where one folder with configuration files leads clearly;
    roots(repo, monorepo, n_files). Of equals by score, code and total the first by name leads."""
    c, keep = F.col, ["config", "total", "code", "hints", "score"]
    top = materialise(project_candidates(folders), "project-candidates")
    best = _two_best(top, [c("score").desc(), c("code").desc(), c("total").desc(), c("prefix")], keep)
    at_root = folders.where("folder = '' AND config > 0").select("repo", F.lit(True).alias("at_root"))
    x = best.join(at_root, "repo", "left").join(roots, "repo").withColumn("at_root", F.coalesce("at_root", F.lit(False)))
    by = lambda mono_root, mono, root, plain: F.when(c("monorepo"), F.when(c("at_root"), mono_root).otherwise(mono)).otherwise(F.when(c("at_root"), root).otherwise(plain))
    lead = c("b").isNull() | (100 * c("a.score") >= c("b.score") * by(125, 115, 140, 120))
    share = F.when(c("all_code") > 0, c("a.code") / F.greatest("all_code", F.lit(1))).otherwise(c("a.total") / c("n_files"))
    ahead = lambda f, k: (F.coalesce(c(f"b.{f}"), F.lit(0)) == 0) | (10 * c(f"a.{f}") >= k * c(f"b.{f}"))  # noqa: E731  in whole numbers, for 1.1 * 70 is more than 77
    strong = (c("a.config") >= 1) & (c("a.hints") >= 2) & (c("a.code") >= 8) & (c("a.total") >= 12)
    clear = (lead & (share >= by(0.55, 0.5, 0.7, 0.55)) & (c("a.code") >= 5)) | (lead & (c("a.config") >= 2) & (c("a.code") >= 10)) | (c("monorepo") & strong & (ahead("score", 11) | ahead("code", 13)))
    return x.where(((c("n") == 1) & ~c("at_root")) | clear).select("repo", "a.prefix")


def dominant_project(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(repo, prefix) of repositories with one top folder, or one that holds most code: 70 % of it and half as much again
    as the next, or 80 %; in a monorepo 55 % and 1.3 times the next, or 65 %."""
    c = F.col
    tops = folders.where("folder <> ''").groupBy("repo", F.substring_index("folder", "/", 1).alias("prefix")).agg(F.sum("total").alias("total"), F.sum("code").alias("code"))
    x = _two_best(tops, [c("code").desc(), c("total").desc(), c("prefix")], ["total", "code"]).join(roots, "repo")
    by = lambda mono, plain: F.when(c("monorepo"), mono).otherwise(plain)
    share, next_code = c("a.code") / F.greatest("all_code", F.lit(1)), F.coalesce(c("b.code"), F.lit(0))
    ahead = (next_code == 0) | (10 * c("a.code") >= by(13, 15) * next_code)
    leads = (c("a.code") > 0) & (((share >= by(0.55, 0.7)) & ahead) | (share >= by(0.65, 0.8)))
    return x.where((c("n") == 1) | leads).select("repo", "a.prefix")


def project_folders(files: DataFrame, also_skipped: tuple[str, ...] = ()) -> DataFrame:
    """(repo, monorepo, prefix, found_by) for each repository of files(repo, path[, content]):
    the folder that all nested files share if they are 60 % of all and it is no mere container,
    else the configured project, else the dominant folder, else the shared container; null
    where nothing tells. Repositories without a file that counts give no row."""
    folders = materialise(folder_facts(files, also_skipped), "folders")
    nested = F.col("folder") != ""
    ends = folders.groupBy("repo").agg(
        F.sum("total").alias("n_files"), F.sum(F.when(nested, F.col("total")).otherwise(0)).alias("n_nested"),
        F.min(F.when(nested, F.col("least"))).alias("least"), F.max(F.when(nested, F.col("greatest"))).alias("greatest"),
    )
    # the least and the greatest path share what all share; a path alone shares its whole self, and nothing lies below it
    reach = F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size("least"), F.size("greatest")), F.lit(1))), lambda k: F.slice("least", 1, k) == F.slice("greatest", 1, k))
    shared = F.when(F.col("least") != F.col("greatest"), F.array_join(F.slice("least", 1, F.coalesce(F.array_max(reach), F.lit(0))), "/"))
    enough = F.col("n_nested") >= 0.6 * F.col("n_files")
    base = materialise(ends.join(monorepos(folders), "repo").withColumn("shared", F.when(enough, F.nullif(shared, F.lit("")))), "repositories")
    roots = base.select("repo", "monorepo", "n_files")
    conf, top = configured_project(folders, roots).withColumnRenamed("prefix", "configured"), dominant_project(folders, roots).withColumnRenamed("prefix", "dominant")
    container = F.lower("shared").isin(*CONTAINERS)
    out = base.where("n_nested > 0").select("repo", "shared").join(conf, "repo", "left").join(top, "repo", "left")
    by = F.when(~container, "shared").when(F.col("configured").isNotNull(), "configured").when(F.col("dominant").isNotNull(), "dominant").when(F.col("shared").isNotNull(), "container")
    found = out.select("repo", by.alias("found_by"), F.when(by == "configured", F.col("configured")).when(by == "dominant", F.col("dominant")).when(by.isNotNull(), F.col("shared")).alias("prefix"))
    return base.select("repo", "monorepo").join(found, "repo", "left").select("repo", "monorepo", "prefix", "found_by")


def script_repositories(files: DataFrame, depth: int = 8) -> DataFrame:
    """(repo, scripts): whether files(repo, path) have a script project's configuration at the root,
    or a script at most `depth` folders down and outside folders of build results."""
    skipped = "|".join(x.replace(".", r"\.") for x in SKIPPED)
    p, endings = F.col("path"), "|".join(x[1:] for x in CODE)
    deep = F.size(F.split(p, "/")) - 1
    script = F.lower(p).rlike(rf"[^/]\.(?:{endings})$") & (deep <= depth) & ~p.rlike(rf"(?:^|/)(?:{skipped})/")
    return files.groupBy("repo").agg(F.coalesce(F.bool_or(p.isin("package.json", "tsconfig.json", "jsconfig.json") | script), F.lit(False)).alias("scripts"))


def schema_snapshots(files: DataFrame) -> DataFrame:
    """(repo, path): the first schema snapshot by name of each repository of files(repo, path) that has one; dot folders are not looked at."""
    return files.where(F.col("path").rlike(SNAPSHOT) & ~F.col("path").rlike(r"(?:^|/)\.")).groupBy("repo").agg(F.min("path").alias("path"))
