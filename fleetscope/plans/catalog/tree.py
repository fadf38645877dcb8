"""Path operators over a file tree: every document gets a path in its source's repository.

The folder follows from the id modulo 8, the file name from the id modulo 11 and 7, so that every
rule on folders, names and extensions meets files it takes and files it leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths
from fleetscope.operators import fleet, packages, scope
from fleetscope.plans.catalog.base import Registry, Tables
from fleetscope.sources import files as file_source
from fleetscope.sources import workspace

QUERIES = Registry()

FOLDERS = ["src/app/", "tests/unit/", "apps/web/src/", "docs/", "web/node_modules/x/", "packages/core/", ".github/w/", ""]
ENDINGS = [".py", ".md", ".json", ".min.js", ".png", ".ts", ".tf"]
NAMES = {0: "Dockerfile", 1: "package.json", 2: "manage.py", 3: "go.mod"}


def files(t: Tables) -> DataFrame:
    doc = F.col("doc_id")
    folder = F.get(paths.literals(FOLDERS), (doc % 8).cast("int"))
    ending = F.get(paths.literals(ENDINGS), (doc % 7).cast("int"))
    name = F
    for n, fixed in NAMES.items():
        name = name.when(doc % 11 == n, F.lit(fixed))
    name = name.otherwise(F.concat(F.lit("f"), doc.cast("string"), ending))
    return t("documents").select(
        F.col("source").alias("repo"), F.concat(folder, name).alias("path"), F.col("n_chars").alias("size"),
        F.col("text").alias("content"),
    )


#: tree(repo, path, name, folder, size, content)
TREE = """
tree AS (
    SELECT source AS repo, folder || name AS path, name, folder, n_chars AS size, text AS content FROM (
        SELECT *, (['src/app/', 'tests/unit/', 'apps/web/src/', 'docs/', 'web/node_modules/x/', 'packages/core/', '.github/w/', ''])[doc_id % 8 + 1] AS folder,
               CASE doc_id % 11 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'package.json' WHEN 2 THEN 'manage.py' WHEN 3 THEN 'go.mod'
               ELSE 'f' || doc_id || (['.py', '.md', '.json', '.min.js', '.png', '.ts', '.tf'])[doc_id % 7 + 1] END AS name
        FROM documents))
"""


@QUERIES.query("text_file_filter", f"""
WITH {TREE} SELECT repo, path, size FROM tree
WHERE NOT (name LIKE '%.min.js' OR name LIKE '%.md' OR name LIKE '%.png' OR (name LIKE '%.json' AND name <> 'package.json'))""")
def text_file_filter(t: Tables) -> DataFrame:
    return scope.text_files(files(t)).select("repo", "path", "size")


@QUERIES.query("test_path_flag", f"WITH {TREE} SELECT repo, path, folder = 'tests/unit/' AS is_test FROM tree")
def flag_test_paths(t: Tables) -> DataFrame:
    return files(t).select("repo", "path", paths.test_path(F.col("path")).alias("is_test"))


@QUERIES.query("module_key", f"""
WITH {TREE} SELECT repo, path, CASE folder WHEN '' THEN '.' WHEN 'docs/' THEN 'docs/' WHEN 'web/node_modules/x/' THEN 'web/'
       WHEN 'tests/unit/' THEN 'tests/' WHEN '.github/w/' THEN '.github/' WHEN 'apps/web/src/' THEN 'apps/web/'
       ELSE folder END AS module FROM tree""")
def module_key(t: Tables) -> DataFrame:
    return files(t).select("repo", "path", paths.module_key(F.col("path")).alias("module"))


@QUERIES.query("eligible_source", f"""
WITH {TREE} SELECT repo, path, size FROM tree
WHERE folder NOT IN ('tests/unit/', 'docs/', 'web/node_modules/x/') AND regexp_matches(name, '[.](py|ts)$')""")
def eligible_source(t: Tables) -> DataFrame:
    return files(t).filter(paths.eligible_source(F.col("path"))).select("repo", "path", "size")


@QUERIES.query("ignore_filter", f"""
WITH {TREE} SELECT repo, path FROM tree
WHERE folder <> 'web/node_modules/x/'
  AND NOT (folder = '.github/w/' AND right(repo, 1) IN ('0', '2', '4', '6', '8'))
  AND NOT (regexp_matches(name, '^f.*5[.]ts$') AND right(repo, 1) IN ('0', '2', '4', '6', '8'))
  AND NOT (starts_with(path, 'docs/') AND right(repo, 1) IN ('1', '3', '5', '7', '9'))""")
def ignore_filter(t: Tables) -> DataFrame:
    """Default rules plus the ignore file of each repository."""
    tree = files(t)
    even = (F.right("repo", F.lit(1)).cast("int") % 2) == 0
    text = F.when(even, "# local\n.github/\n\nf*5.ts\n").otherwise("docs/*\n")
    ignore_file = tree.select("repo").distinct().select("repo", F.lit(".gitignore").alias("path"), text.alias("content"))
    rules = scope.ignore_rules(ignore_file)
    return scope.drop_ignored(tree.select("repo", "path"), rules=rules)


@QUERIES.query("infra_signals", f"""
WITH {TREE} SELECT DISTINCT repo, CASE WHEN name = 'Dockerfile' THEN 'Docker' ELSE 'Terraform' END AS signal FROM tree
WHERE folder NOT IN ('web/node_modules/x/', '.github/w/') AND (name = 'Dockerfile' OR name LIKE '%.tf')""")
def infra_signals(t: Tables) -> DataFrame:
    return fleet.infra_signals(files(t))


@QUERIES.query("languages", f"""
WITH {TREE} SELECT DISTINCT repo, CASE name WHEN 'package.json' THEN 'JavaScript/TypeScript' ELSE 'Go' END AS language
FROM tree WHERE name IN ('package.json', 'go.mod')""")
def languages(t: Tables) -> DataFrame:
    return packages.languages(files(t))


@QUERIES.query("stack_summary", f"""
WITH {TREE},
lang AS (SELECT repo, string_agg(DISTINCT CASE name WHEN 'package.json' THEN 'JavaScript/TypeScript' ELSE 'Go' END, ',' ORDER BY CASE name WHEN 'package.json' THEN 'JavaScript/TypeScript' ELSE 'Go' END) AS languages
         FROM tree WHERE name IN ('package.json', 'go.mod') GROUP BY repo),
fw AS (SELECT DISTINCT repo, 'Django' AS frameworks FROM tree WHERE name = 'manage.py'),
deps AS (SELECT source AS repo, count(DISTINCT lang) AS dependencies FROM documents GROUP BY source)
SELECT repo, coalesce(languages, '') AS languages, coalesce(frameworks, '') AS frameworks, dependencies, false AS is_empty
FROM deps LEFT JOIN lang USING (repo) LEFT JOIN fw USING (repo)
UNION ALL SELECT 'idle' || n_nationkey, '', '', 0, true FROM nation""")
def stack_summary(t: Tables) -> DataFrame:
    tree = files(t)
    deps = t("documents").select(F.col("source").alias("repo"), F.col("lang").alias("dependency")).distinct()
    idle = t("nation").select(F.concat(F.lit("idle"), F.col("n_nationkey").cast("string")).alias("repo"))
    out = packages.stack_summary(
        tree.select("repo").union(idle), packages.languages(tree), packages.frameworks(deps, tree), deps
    )
    return out.select("repo", F.array_join("languages", ",").alias("languages"), F.array_join("frameworks", ",").alias("frameworks"), "dependencies", "is_empty")


@QUERIES.query("context_files", r"""
WITH parts AS (
    SELECT source AS repo, CASE WHEN doc_id % 3 = 0 THEN 'README.md' ELSE 'AGENTS.md' END AS name, text,
           string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS p
    FROM documents WHERE doc_id % 9 IN (0, 1)),
trimmed AS (SELECT repo, name, text, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts)
SELECT repo, name, len(p) AS lines_count, text AS content,
       CASE WHEN name = 'README.md' OR len(p) >= 200 THEN array_to_string(p[1:10], chr(10)) ELSE text END AS preview
FROM trimmed""")
def context_files(t: Tables) -> DataFrame:
    """Files named readme.md, agents.md or other.txt, in any case."""
    kind = F.col("doc_id") % 9
    name = F.when(kind == 0, "ReadMe.md").when(kind == 1, "agents.MD").otherwise("other.txt")
    docs = t("documents").select(F.col("source").alias("repo"), name.alias("path"), F.col("text").alias("content"))
    return file_source.context_files(docs).withColumn("lines_count", F.col("lines_count").cast("bigint"))


@QUERIES.query("workspace_members", f"""
WITH {TREE},
kinds AS (SELECT DISTINCT source AS repo, CAST(substr(source, 4) AS INTEGER) % 5 AS kind FROM documents),
globs AS (
    SELECT repo, unnest(CASE kind WHEN 0 THEN ['^apps/[^/]*$', '^packages/[^/]*$'] WHEN 1 THEN ['^packages/core$']
        WHEN 2 THEN ['^apps/[^/]*$'] WHEN 3 THEN ['^[^/]*/[^/]*$'] END) AS g FROM kinds),
dirs AS (
    SELECT DISTINCT repo, array_to_string(s[1:n], '/') AS folder
    FROM (SELECT repo, string_split(path, '/') AS s FROM tree), unnest(range(1, 5)) AS r(n) WHERE n < len(s)),
hits AS (
    SELECT DISTINCT repo, string_split(folder, '/')[-1] AS name, folder || '/' AS prefix
    FROM dirs JOIN globs USING (repo) WHERE regexp_matches(folder, g) AND string_split(folder, '/')[-1] <> 'node_modules'),
members AS (
    SELECT * FROM hits UNION ALL SELECT repo, repo, '' FROM kinds WHERE repo NOT IN (SELECT repo FROM hits))
SELECT repo, members.name, prefix, count(*) AS files
FROM members JOIN tree USING (repo) WHERE starts_with(path, prefix) GROUP BY ALL""")
def workspace_members(t: Tables) -> DataFrame:
    """Members of differently defined workspaces, with the files below each."""
    tree = files(t).select("repo", "path")
    kind = F.substring("repo", 4, 10).cast("int") % 5
    repos = tree.select("repo").distinct().withColumn("kind", kind)
    path = F.when(F.col("kind") == 0, "pnpm-workspace.yaml").when(F.col("kind") == 1, "lerna.json").when(
        F.col("kind") == 2, "package.json").when(F.col("kind") == 3, "Cargo.toml").otherwise("notes.txt")
    text = (
        F.when(F.col("kind") == 0, "# all\npackages:\n  - 'apps/*'\n  - \"packages/*\"\n  - '!packages/old'\ncatalog:\n  - x/*\n")
        .when(F.col("kind") == 1, '{"packages": ["packages/core", " "]}')
        .when(F.col("kind") == 2, '{"workspaces": {"packages": ["apps/*"]}}')
        .when(F.col("kind") == 3, '[package]\nname = "x"\n[workspace]\nmembers = ["*/*", "docs"]\nexclude = ["docs"]\n')
        .otherwise("packages:\n  - 'docs'\n")
    )
    definitions = repos.select("repo", path.alias("path"), text.alias("content"))
    members = workspace.workspace_members(tree, workspace.workspace_patterns(definitions))
    rooted = members.filter("prefix IS NOT NULL")
    below = scope.under_prefixes(tree, rooted).groupBy("repo", "name", "prefix").agg(F.count(F.lit(1)).alias("files"))
    single = tree.join(members.filter("prefix IS NULL"), "repo").groupBy("repo", "name").agg(F.count(F.lit(1)).alias("files"))
    return below.unionByName(single.withColumn("prefix", F.lit("")))


#: Patterns per source, by the last digit of its name.
GLOBS = {0: ["*/9*"], 1: ["apps/*/[!0-4]*", "docs/?"], 2: ["nothing"], 3: []}


@QUERIES.query("glob_match", f"""
WITH {TREE},
asked AS (SELECT *, CAST(substr(repo, 4) AS INTEGER) % 4 AS kind FROM tree)
SELECT repo, path, CASE kind WHEN 0 THEN regexp_matches(path, '^.*/9.*$') WHEN 1 THEN regexp_matches(path, '^(apps/.*/[^0-4].*|docs/.)$') ELSE false END AS hit FROM asked""")
def glob_match(t: Tables) -> DataFrame:
    """Paths against the globs of their own repository, some of which have none."""
    kind = F.substr("repo", F.lit(4)).cast("int") % 4
    patterns = None
    for n, globs in GLOBS.items():
        listed = F.array(*[F.lit(g) for g in globs]).cast("array<string>")
        patterns = (F if patterns is None else patterns).when(kind == n, listed)
    return files(t).select("repo", "path", paths.matches_any_glob(F.col("path"), patterns).alias("hit"))


@QUERIES.query("shallow_files", f"WITH {TREE} SELECT repo, path FROM tree WHERE length(path) - length(replace(path, '/', '')) <= 1")
def shallow_files(t: Tables) -> DataFrame:
    return scope.within_depth(files(t), 1).select("repo", "path")
