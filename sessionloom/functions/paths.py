"""What a file path says about what is touched."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in the order in which they are tried: scope, whole folder names, whole file names, patterns of file names.
TEST_FOLDERS = ("tests", "test", "spec", "specs", "__tests__", "__test__")
TEST_NAMES = r"_test\.|test_|\.test\.|\.spec\."
CI_FILES = ("jenkinsfile", ".travis.yml", ".circleci", "azure-pipelines.yml", "bitbucket-pipelines.yml", "cloudbuild.yaml")
CONTAINER_FILES = ("docker-compose.yml", "docker-compose.yaml", ".dockerignore")
DOC_FOLDERS = ("docs", "doc", "documentation")
DOC_FILES = ("readme.md", "contributing.md", "changelog.md", "license.md")
DEPENDENCY_FILES = ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "requirements.txt", "setup.py", "setup.cfg", "pyproject.toml", "poetry.lock", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "gemfile", "gemfile.lock", "composer.json", "composer.lock", "pom.xml", "build.gradle")
ENVIRONMENT_FILES = (".env", ".envrc", ".env.local", ".env.development", ".env.production")
INFRASTRUCTURE_FOLDERS = ("helm", "charts", "k8s", "kubernetes", "terraform", "infra")
INFRASTRUCTURE_NAMES = r"\.(tf|tfvars|hcl)$"


def scope_of(path: Column) -> Column:
    """The scope that the first fitting rule gives; null if none fits."""
    low = F.lower(F.regexp_replace(path, r"\\", "/"))
    parts, name = F.split(low, "/"), F.substring_index(low, "/", -1)
    inside = lambda folders: F.arrays_overlap(parts, F.array(*map(F.lit, folders)))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", None)
        .when(inside(TEST_FOLDERS) | name.rlike(TEST_NAMES), "test_code")
        .when((inside((".github",)) & (inside(("workflows",)) | (name == "dependabot.yml"))) | name.isin(*CI_FILES), "ci_cd_config")
        .when(name.startswith("dockerfile") | name.isin(*CONTAINER_FILES), "container_image")
        .when(inside(DOC_FOLDERS) | name.isin(*DOC_FILES), "documentation")
        .when(name.isin(*DEPENDENCY_FILES), "dependency")
        .when(name.isin(*ENVIRONMENT_FILES), "environment")
        .when(name.rlike(INFRASTRUCTURE_NAMES) | inside(INFRASTRUCTURE_FOLDERS), "infrastructure")
    )


def first_path(payload: Column) -> Column:
    """The first path of a payload (map of strings): its own keys before those of its arguments."""
    keys = [k for prefix in ("", "arguments.") for k in (f"{prefix}path", f"{prefix}file_path", f"{prefix}file", f"{prefix}filename")]
    return F.coalesce(*[F.nullif(F.try_element_at(payload, F.lit(k)), F.lit("")) for k in keys])


def normal(path: Column) -> Column:
    """Without empty and `.` parts; `x/..` goes."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    step = lambda done, p: F.when((p == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != ".."), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when((p == "..") & path.startswith("/"), done).otherwise(F.concat(done, F.array(p)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), lambda d, p: F.when(F.size(d) == 0, F.when((p == "..") & path.startswith("/"), d).otherwise(F.array(p))).otherwise(step(d, p))), "/")
    return F.when(path.startswith("/"), F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def context_points(target: Column, root: Column) -> Column:
    """-8 inside the project, 15 outside of it; 4 where no project is known."""
    t, r = normal(target), normal(root)
    inside = F.when(t.startswith("/"), (t == r) | t.startswith(F.concat(r, F.lit("/")))).otherwise(~t.startswith(".."))
    return F.when(root.isNull(), 4).when(inside, -8).otherwise(15)
