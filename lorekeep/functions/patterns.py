"""Patterns and name lists that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_BUMP = r"(?i)^(?:chore(?:\([^)]*\))?:\s*bump version\b.*|v?\d+(?:\.\d+)+)$"

#: Lines of a diff with one of these are left out whole.
SECRETS = (
    r"AIza[0-9A-Za-z_\-]{35}",
    r"BEGIN [A-Z0-9 ]*KEY",
    r"""(?i)(?:key|secret|password|passwd|token)\w*["']?\s*[:=]\s*["']?[^\s"',;]+""",
    r"(?i)\b[a-z][a-z0-9+.\-]*://[^/\s:@]+:[^/\s@]+@",
    r"\$2[aby]\$\d{2}\$[./A-Za-z0-9]{53}",
)

LOCKFILES = (
    "package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "poetry.lock",
    "pipfile.lock", "uv.lock", "cargo.lock", "gemfile.lock", "composer.lock", "go.sum",
)
IMAGE_SUFFIXES = ("png", "jpg", "jpeg", "gif", "webp", "ico", "bmp", "svg", "tif", "tiff", "avif")

#: What a leak scan looks for, by kind.
LEAKS = {
    "drive path": r"(?<![A-Za-z])[A-Za-z]:[\\/][^\s'\"`)\]>,;]*",
    "home path": r"(?<![\w:.])(?:/home/|/Users/)[^\s'\"`)\]>,;]+",
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "google api key": r"AIza[0-9A-Za-z_\-]{35}",
}
#: Never accepted and never shown.
SECRET_KINDS = ("google api key",)
#: Domains reserved for documentation and tests.
PLACEHOLDER = (
    r"(?i)@(?:[\w-]+\.)*(?:example\.(?:com|org|net)|[\w-]+\.(?:invalid|test|local|localhost|example))$"
)
#: A NUL among so many first bytes makes a file binary.
BINARY_SNIFF = 8_000

STOP_WORDS = tuple(
    "a an and are as at be by did do for from how i in is it my of on or that the this to was we what when where"
    " which with".split()
)

INCLUDE_PATTERNS = (
    "README.md", "CLAUDE_SUMMARY.md", "PROJECT_STATUS.md", "CLAUDE.md", "AGENTS*.md", "DECISIONS.md", "ROADMAP.md",
    "HANDOVER.md", "EXPLAINER.md", "*BRIEF.md", "*SPEC.md", "AI_*.md",
)
INCLUDE_DIRS = ("docs",)
EXCLUDE_DIRS = ("node_modules", "venv", "build", "dist", "__pycache__", "target")


def looks_secret(line: Column) -> Column:
    found = F.lit(False)
    for pattern in SECRETS:
        found = found | line.rlike(pattern)
    return found


def left_out_of_excerpts(path: Column) -> Column:
    """Lock files, images, environment files and keys, by file name."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return (
        name.isin(*LOCKFILES)
        | name.rlike(r".\.(?:" + "|".join(IMAGE_SUFFIXES) + ")$")
        | name.startswith(".env")
        | name.endswith(".pem")
    )
