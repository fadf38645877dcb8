"""Roles of services and the architecture line of a system."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.functions import paths
from fleetscope.operators.ordered import with_part
from fleetscope.operators.packages import lookup

# Fixed values.
FRONTEND = ["Next.js", "React", "Vue", "Angular", "Svelte", "Nuxt.js", "Remix", "Vite"]
BACKEND = [
    "FastAPI", "Django", "Django REST Framework", "Flask", "Express", "NestJS", "Gin", "Echo", "Fiber",
    "Spring Boot", "Quarkus", "Micronaut", "Rails", "Laravel", "Symfony", "Slim", "Sinatra",
    "Actix Web", "Axum", "Rocket",
]
INFRA_FILES = {
    "Dockerfile": "Docker",
    "docker-compose.yml": "Docker Compose",
    "docker-compose.yaml": "Docker Compose",
    "Chart.yaml": "Helm",
}
INFRA_SUFFIXES = {".tf": "Terraform", ".tfvars": "Terraform"}
ROLES = ["Frontend", "Backend", "Infra", "Shared"]
NO_STACK = "(no stack detected)"
LABELS_PER_PART = 1000


def infra_label(name: Column, files: dict[str, str] = INFRA_FILES, suffixes: dict[str, str] = INFRA_SUFFIXES) -> Column:
    by_suffix = None
    for ending, label in suffixes.items():
        by_suffix = (F if by_suffix is None else by_suffix).when(name.endswith(ending), F.lit(label))
    return F.coalesce(lookup(name, files), by_suffix)


def infra_signals(files: DataFrame, repo: str = "repo", path: str = "path") -> DataFrame:
    """Distinct infrastructure labels by file name, at any depth, outside hidden folders."""
    location = F.col(path)
    folders = F.slice(paths.segments(location), F.lit(1), F.greatest(F.size(paths.segments(location)) - 1, F.lit(0)))
    hidden = F.exists(folders, lambda f: f.startswith(".") | (f == "node_modules"))
    kept = files.filter(~hidden)
    return (
        kept.select(repo, infra_label(paths.basename(location)).alias("signal"))
        .filter(F.col("signal").isNotNull())
        .distinct()
    )


def role_of(frameworks: Column, signals: Column, frontend: Sequence[str] = FRONTEND, backend: Sequence[str] = BACKEND) -> Column:
    """Frontend wins over backend, backend over infrastructure."""
    return (
        F.when(F.arrays_overlap(frameworks, paths.literals(frontend)), "Frontend")
        .when(F.arrays_overlap(frameworks, paths.literals(backend)), "Backend")
        .when(F.size(signals) > 0, "Infra")
        .otherwise("Shared")
    )


def service_tiers(
    services: DataFrame,
    keys: Sequence[str] = ("repo",),
    frameworks: str = "frameworks",
    signals: str = "signals",
    frontend: Sequence[str] = FRONTEND,
    backend: Sequence[str] = BACKEND,
) -> DataFrame:
    """Role and displayed stack of each service; ``frameworks`` and ``signals`` are sorted arrays."""
    shown = (
        F.when(F.size(frameworks) > 0, F.col(frameworks))
        .when(F.size(signals) > 0, F.col(signals))
        .otherwise(F.array(F.lit(NO_STACK)))
    )
    return services.select(
        *keys, role_of(F.col(frameworks), F.col(signals), frontend, backend).alias("role"), shown.alias("stack")
    )


def architecture_line(
    tiers: DataFrame, system: Sequence[str] = ("system",), service: str = "repo", per_part: int = LABELS_PER_PART
) -> DataFrame:
    """``(system, role, part, line)``: the services of each role as one text.

    A role with more than about ``per_part`` services is written in several parts, so that no row
    grows with the fleet; ``position`` is the fixed order of roles.
    """
    keys = list(system)
    label = F.concat(F.array_join("stack", ", "), F.lit(" ("), F.col(service).cast("string"), F.lit(")"))
    parts = with_part(
        tiers.select(*keys, "role", F.col(service).alias("__s"), label.alias("__label")),
        [*keys, "role"], F.col("__s"), per_part,
    )
    ordered = F.array_sort(F.collect_list(F.struct("__s", "__label")))
    text = F.array_join(F.transform(ordered, lambda x: x["__label"]), " | ")
    return parts.groupBy(*keys, "role", "part").agg(text.alias("__text")).select(
        *keys,
        "role",
        F.array_position(paths.literals(ROLES), F.col("role")).alias("position"),
        "part",
        F.concat(F.col("role"), F.lit(": "), F.col("__text")).alias("line"),
    )
