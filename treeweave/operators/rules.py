"""Named exclude rules: categories, presets and the filters built on them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from treeweave.functions.globs import matches_any


# Exclude patterns by category.
CATEGORY_RULES = {
    "lock_files": [
        "*.lock", "Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lockb", "composer.lock",
        "Pipfile.lock", "poetry.lock", "Gemfile.lock", "go.sum", "mix.lock", "pubspec.lock", "packages-lock.json",
        "vcpkg.json",
    ],
    "dependencies": [
        "node_modules/*", "vendor/*", "target/*", ".cargo/*", "__pycache__/*", ".venv/*", "venv/*", "env/*",
        "site-packages/*", "gems/*", "bower_components/*", "jspm_packages/*", ".pub-cache/*", "Packages/*", "Library/*",
        "obj/*", "bin/*", "pkg/*", "_build/*", "deps/*",
    ],
    "build_artifacts": [
        "dist/*", "build/*", "out/*", ".next/*", ".nuxt/*", ".svelte-kit/*", ".output/*", "coverage/*", ".nyc_output/*",
        "*.tsbuildinfo", "*.buildlog", "cmake-build-*/*", "Release/*", "Debug/*", "x64/*", "x86/*", ".gradle/*",
        "gradle/*", "*.class", "*.o", "*.a", "*.obj", "*.lib", "*.exp", "*.pdb", "*.ilk",
    ],
    "ide_files": [
        ".vscode/*", ".idea/*", "*.swp", "*.swo", "*~", ".DS_Store", "Thumbs.db", "*.tmp", ".vs/*", "*.vcxproj.user",
        "*.suo", "*.user", ".vimrc.local", ".sublime-*", "*.sublime-workspace", ".fleet/*", ".zed/*",
    ],
    "media_files": [
        "*.png", "*.jpg", "*.jpeg", "*.gif", "*.bmp", "*.tiff", "*.tga", "*.ico", "*.svg", "*.webp", "*.avif", "*.heic",
        "*.raw", "*.psd", "*.ai", "*.eps", "*.mp4", "*.avi", "*.mov", "*.wmv", "*.flv", "*.webm", "*.mkv", "*.m4v",
        "*.3gp", "*.asf", "*.mp3", "*.wav", "*.flac", "*.aac", "*.ogg", "*.wma", "*.m4a", "*.opus",
    ],
    "binary_files": [
        "*.zip", "*.tar", "*.gz", "*.bz2", "*.xz", "*.rar", "*.7z", "*.dmg", "*.iso", "*.exe", "*.msi", "*.app",
        "*.deb", "*.rpm", "*.pkg", "*.dll", "*.so", "*.dylib", "*.bin", "*.dat", "*.img",
    ],
    "documents": [
        "*.pdf", "*.doc", "*.docx", "*.xls", "*.xlsx", "*.ppt", "*.pptx", "*.odt", "*.ods", "*.odp", "*.rtf", "*.pages",
        "*.numbers", "*.keynote",
    ],
    "data_files": [
        "*.db", "*.sqlite", "*.sqlite3", "*.db3", "*.dump", "*.sql", "*.bak", "*.mdb", "*.accdb", "*.csv", "*.json",
        "*.xml", "*.yaml", "*.yml", "*.parquet", "*.arrow", "*.avro",
    ],
    "fonts": [
        "*.ttf", "*.otf", "*.woff", "*.woff2", "*.eot", "*.pfb", "*.pfm", "*.afm", "*.fon", "*.fnt",
    ],
    "logs": [
        "*.log", "logs/*", "log/*", "*.out", "*.err", "nohup.out", "*.trace", "*.pid",
    ],
    "cache": [
        ".cache/*", "cache/*", ".temp/*", "temp/*", "tmp/*", ".tmp/*", "*.cache", ".parcel-cache/*", ".turbo/*",
        ".swc/*", ".eslintcache", ".stylelintcache", ".prettiercache", "*.tsbuildinfo", ".rollup.cache/*",
    ],
    "os_files": [
        ".DS_Store", ".AppleDouble", ".LSOverride", "._*", ".DocumentRevisions-V100", ".fseventsd", ".Spotlight-V100",
        ".TemporaryItems", ".Trashes", ".VolumeIcon.icns", ".com.apple.timemachine.donotpresent", ".AppleDB",
        ".AppleDesktop", "Network Trash Folder", "Temporary Items", ".apdisk", "Thumbs.db", "Thumbs.db:encryptable",
        "ehthumbs.db", "ehthumbs_vista.db", "*.stackdump", "[Dd]esktop.ini", "$RECYCLE.BIN/*", "*.cab", "*.lnk",
    ],
    "version_control": [
        ".git/*", ".svn/*", ".hg/*", ".bzr/*", "_darcs/*", ".pijul/*", "CVS/*", ".cvs/*", "SCCS/*", "RCS/*",
        ".gitignore_global", ".gitkeep", ".gitattributes_global",
    ],
    "secrets": [
        ".env", ".env.local", ".env.*.local", ".env.production", ".env.development", ".env.staging", ".env.test",
        "*.key", "*.pem", "*.crt", "*.cert", "*.p12", "*.pfx", "*.jks", "*.keystore", "id_rsa", "id_dsa", "id_ecdsa",
        "id_ed25519", "*.ppk", ".ssh/*", "credentials", "secrets.json", "config.json", ".aws/*", ".azure/*", ".gcloud/*",
    ],
}
# What code-only excludes besides.
CODE_ONLY_EXTRA = [
    "*.md", "*.txt", "*.rst", "LICENSE*", "CHANGELOG*", "README*", "CONTRIBUTING*", "AUTHORS*", "CREDITS*", "NOTICE*",
]
MINIMAL_CATEGORIES = ["media_files", "binary_files", "documents", "fonts", "version_control", "secrets"]
PRESETS = ["raw", "standard", "code-only", "minimal"]


def category_patterns(categories: Iterable[str]) -> list[str]:
    """Distinct patterns of the named categories; unknown names add nothing."""
    return sorted({p for name in categories for p in CATEGORY_RULES.get(name, [])})


DEFAULT_PATTERNS = category_patterns(CATEGORY_RULES)
PRESET_PATTERNS = {
    "raw": [],
    "standard": DEFAULT_PATTERNS,
    "code-only": sorted({*DEFAULT_PATTERNS, *CODE_ONLY_EXTRA}),
    "minimal": category_patterns(MINIMAL_CATEGORIES),
}


def preset_name(text: Column, raw: Column | None = None) -> Column:
    """Canonical preset of a request: any case, three spellings of code-only, unknown means standard."""
    lowered = F.lower(text)
    named = (
        F.when(lowered.isin("raw", "minimal"), lowered)
        .when(lowered.isin("code-only", "code_only", "codeonly"), F.lit("code-only"))
        .otherwise(F.lit("standard"))
    )
    return named if raw is None else F.when(F.coalesce(raw, F.lit(False)), F.lit("raw")).otherwise(named)


def dropped_under(preset: str, path: Column) -> Column:
    """Whether one preset drops the path; code-only repeats the test of standard, which is then shared."""
    if preset == "code-only":
        return matches_any(DEFAULT_PATTERNS, path) | matches_any(CODE_ONLY_EXTRA, path)
    return matches_any(PRESET_PATTERNS[preset], path)


def rule_table(spark: SparkSession) -> DataFrame:
    """The rules as a table (category, pattern), for joins with tables of patterns."""
    rows = [(c, p) for c, patterns in CATEGORY_RULES.items() for p in patterns]
    rows += [("code_only_extra", p) for p in CODE_ONLY_EXTRA]
    return spark.createDataFrame(rows, "category string, pattern string")


def preset_filter(files: DataFrame, presets: Iterable[str] = PRESETS) -> DataFrame:
    """Files kept under each preset, one row per (file, preset) that keeps it; one narrow pass, no shuffle."""
    path = F.col("path")
    keeps = [
        F.when(~dropped_under(name, path), F.lit(name)) for name in presets
    ]
    return files.withColumn("preset", F.explode(F.array_compact(F.array(*keeps))))


def category_filter(files: DataFrame, categories: Iterable[str]) -> DataFrame:
    return files.where(~matches_any(category_patterns(categories), F.col("path")))


def effective_patterns(exclude: Iterable[str], preset: str | None, apply_defaults: bool) -> list[str]:
    base = PRESET_PATTERNS[preset] if preset else DEFAULT_PATTERNS if apply_defaults else []
    return sorted({*exclude, *base})


def effective_filter(
    files: DataFrame, exclude: Iterable[str] = (), preset: str | None = None, apply_defaults: bool = True
) -> DataFrame:
    """User patterns together with the preset, or with the defaults where no preset is named."""
    return files.where(~matches_any(effective_patterns(exclude, preset, apply_defaults), F.col("path")))


def custom_default_filter(files: DataFrame, extra: Iterable[str]) -> DataFrame:
    return files.where(~matches_any({*DEFAULT_PATTERNS, *extra}, F.col("path")))


def redundant_patterns(pattern_rows: DataFrame) -> DataFrame:
    """Patterns of a request log that are defaults already, with their request counts."""
    return (
        pattern_rows.where(F.col("pattern").isin(DEFAULT_PATTERNS))
        .groupBy("pattern")
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def exclusion_census(files: DataFrame) -> DataFrame:
    """Files and bytes hit by each category; a file may count in several."""
    hits = [
        F.when(matches_any(patterns, F.col("path")), F.lit(name)) for name, patterns in CATEGORY_RULES.items()
    ]
    return (
        files.select("size", F.explode(F.array_compact(F.array(*hits))).alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    )
