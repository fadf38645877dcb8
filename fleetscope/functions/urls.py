"""Repository URL normalisation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetscope.functions.paths import literals
from fleetscope.functions.text import strip

# Path segments behind which a URL points inside a repository.
NOISE_SEGMENTS = [
    "-", "actions", "blob", "commit", "commits", "issues", "merge_requests", "pipelines",
    "projects", "pull", "pulls", "raw", "releases", "src", "tree", "wiki",
]
# Public hosts and their canonical names.
PUBLIC_HOSTS = {
    "github.com": "github.com",
    "www.github.com": "github.com",
    "gitlab.com": "gitlab.com",
    "www.gitlab.com": "gitlab.com",
    "bitbucket.org": "bitbucket.org",
    "www.bitbucket.org": "bitbucket.org",
}
SHORTHAND_HOST = "github.com"

WEB_URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)"
SCP_URL = r"^git@([^:]+):(.+)$"
SHORTHAND = r"^([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$"


def repo_segments(path: Column, noise: Sequence[str] = NOISE_SEGMENTS, minimum: int = 2) -> Column:
    """Owner/group/name segments before the first noise segment, ``.git`` removed; NULL if too few."""
    inside = "/(?:" + "|".join(noise) + ")/.*$"
    closed = F.concat(F.lit("/"), strip(path), F.lit("/"))
    kept = F.filter(F.split(F.regexp_replace(closed, f"(?s){inside}", "/"), "/"), lambda s: s != "")
    named = F.transform(kept, lambda s: F.regexp_replace(s, r"\.git$", ""))
    return F.when((F.size(named) >= minimum) & ~F.array_contains(named, ""), named)


def _target(clone_url: Column, name: Column) -> Column:
    return F.struct(clone_url.alias("clone_url"), name.alias("display_name"))


def repo_target(value: Column, noise: Sequence[str] = NOISE_SEGMENTS, minimum: int = 2) -> Column:
    """``struct<clone_url, display_name>`` of an scp-style, http(s) or ``owner/name`` address."""
    text = strip(value)
    ssh_path = F.array_join(repo_segments(F.regexp_extract(text, SCP_URL, 2), noise, minimum), "/")
    ssh_host = F.regexp_extract(text, SCP_URL, 1)
    web_path = F.array_join(repo_segments(F.regexp_extract(text, WEB_URL, 3), noise, minimum), "/")
    scheme = F.lower(F.regexp_extract(text, WEB_URL, 1))
    host = F.regexp_extract(text, WEB_URL, 2)
    repo = F.regexp_replace(F.regexp_extract(text, SHORTHAND, 2), r"\.git$", "")
    short = F.concat_ws("/", F.regexp_extract(text, SHORTHAND, 1), repo)
    return (
        F.when(
            text.rlike(SCP_URL) & ssh_path.isNotNull(),
            _target(F.concat(F.lit("git@"), ssh_host, F.lit(":"), ssh_path, F.lit(".git")), ssh_path),
        )
        .when(
            text.rlike(WEB_URL) & web_path.isNotNull(),
            _target(F.concat(scheme, F.lit("://"), host, F.lit("/"), web_path), web_path),
        )
        .when(
            text.rlike(SHORTHAND) & ~text.rlike("^[.~]") & (repo != ""),
            _target(F.concat(F.lit(f"https://{SHORTHAND_HOST}/"), short), short),
        )
    )


def public_repo_url(
    value: Column,
    hosts: Mapping[str, str] = PUBLIC_HOSTS,
    noise: Sequence[str] = NOISE_SEGMENTS,
    minimum: int = 2,
) -> Column:
    """Canonical https URL on an allowed host; NULL for anything else (SSH, http, userinfo, other hosts)."""
    target = repo_target(value, noise, minimum)
    url = target["clone_url"]
    authority = F.regexp_extract(url, "^https://([^/]+)/", 1)
    host = F.regexp_replace(F.lower(authority), r":\d*$", "")
    canonical = None
    for alias, name in hosts.items():
        canonical = (F if canonical is None else canonical).when(host == alias, F.lit(name))
    allowed = ~F.lower(strip(value)).rlike("^(?:git@|ssh://)") & ~F.contains(authority, F.lit("@"))
    return F.when(allowed, F.concat(F.lit("https://"), canonical, F.lit("/"), target["display_name"]))


def host_allowed(host: Column, hosts: Sequence[str]) -> Column:
    return F.array_contains(literals(hosts), F.lower(host))
