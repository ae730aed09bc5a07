"""Who a project is, what a caller may see, and the guards before any read."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t

# Folders that are never a project's root.
PERSONAL = {"desktop", "documents", "downloads", "onedrive"}
SYSTEM = {"/bin", "/boot", "/dev", "/etc", "/lib", "/proc", "/sbin", "/sys", "/usr", "/var"}


def git_remote(url: Column) -> Column:
    """A remote's address in one form: scp style becomes ssh, lower case, no credentials, no .git, no default port."""
    trimmed = F.lower(F.trim(url))
    ssh = F.when(F.rlike(trimmed, F.lit("^[a-z]+://")), trimmed).otherwise(F.regexp_replace(trimmed, r"^(?:[^@/]+@)?([^:/]+):(.+)$", "ssh://$1/$2"))
    bare = F.regexp_replace(F.regexp_replace(ssh, r"://[^@/]*@", "://"), r"(://[^/:]+):(?:22|80|443)(/|$)", "$1$2")
    return F.regexp_replace(F.regexp_replace(bare, r"/+$", ""), r"\.git$", "")


def canonical_key(projects: DataFrame) -> Column:
    """The first identity a project has: remote with root commit and folder tree, shared repository, repository path, folder path."""
    h = lambda c: F.sha2(c, 256)
    tree = F.concat(F.lit("#tree:"), h(F.col("tree")))
    return F.coalesce(
        F.concat(F.lit("git:"), git_remote(F.col("remote")), F.lit("#"), F.col("root_commit"), tree),
        F.concat(F.lit("git-common:"), h(F.col("git_common")), tree),
        F.concat(F.lit("git-path:"), h(F.col("git_path"))),
        F.concat(F.lit("directory-path:"), h(F.col("path"))),
    )


def register(found: DataFrame, projects: DataFrame, aliases: DataFrame) -> DataFrame:
    """path, project_id, match_method: by canonical key, else by known path, else a new project.

    found: path, canonical_key; projects: project_id, canonical_key; aliases: path, project_id."""
    by_key = found.join(projects.select("canonical_key", F.col("project_id").alias("k")), "canonical_key", "left")
    both = by_key.join(aliases.groupBy("path").agg(F.min("project_id").alias("a")), "path", "left")
    method = F.when(F.col("k").isNotNull(), "canonical_key").when(F.col("a").isNotNull(), "resolved_path").otherwise("created")
    return both.select("path", F.coalesce("k", "a", t.uuid5(t.PROJECT_NAMESPACE, F.col("canonical_key"))).alias("project_id"), method.alias("match_method"))


def structure_signature(listing: DataFrame) -> DataFrame:
    """project_id, structure_hash: the sorted names and marker contents of a project's visible children.

    listing: project_id, name, kind, content_hash (null unless a marker)."""
    line = F.concat_ws("|", "kind", F.lower("name"), F.coalesce("content_hash", F.lit("")))
    return listing.filter(~F.startswith("name", F.lit("."))).groupBy("project_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("structure_hash"))


def git_tracked(spark: SparkSession, root: str) -> DataFrame | None:
    """relative_path of the files that git tracks below a root; None only if it says that this is no repository."""
    done = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached"], capture_output=True, timeout=120)
    if done.returncode:
        if b"not a git repository" in done.stderr:
            return None
        raise RuntimeError(done.stderr.decode("utf-8", "replace")[:500])
    names = sorted({x.decode("utf-8", "surrogateescape") for x in done.stdout.split(b"\0") if x})
    return spark.createDataFrame([(n,) for n in names], "relative_path string")


def tracked_or_walked(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The files that git tracks, or all where there is no repository; any other failure of git is raised."""
    tracked = git_tracked(spark, root)
    return files if tracked is None else files.join(tracked, "relative_path", "left_semi")


def refuse_root(path: str, home: str | None = None) -> str | None:
    """Why a folder is too wide to be read as a project, or None."""
    own = os.path.normpath(path)
    home = os.path.normpath(home or os.path.expanduser("~"))
    if own == os.path.dirname(own):
        return "filesystem_root"
    if own in (home, os.path.dirname(home)):
        return "profile"
    if os.path.dirname(own) == home and os.path.basename(own).lower() in PERSONAL:
        return "personal_folder"
    if os.path.dirname(own) == home and os.path.basename(own).startswith("."):
        return "hidden_profile_folder"
    if any(own == s or own.startswith(s + "/") for s in SYSTEM):
        return "system_folder"
    return None


def visible(items: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows of allowed projects; rows without a project pass."""
    return items.filter("project_id is not null").join(allowed.select("project_id").distinct(), "project_id", "left_semi").unionByName(items.filter("project_id is null"))
