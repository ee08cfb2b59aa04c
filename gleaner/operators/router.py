"""Routing: which tiers a file goes to, from a table of peeks, as column expressions.

Peeks: ext, name, size_bytes, page_count, text_density, extractable, image_ratio, row_count, width, height, peek_text and
peek_error; a folder's wishes: accuracy, visual (`always`, `never`) and budget_gb.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import routing
from gleaner.functions import text as T
from gleaner.operators import budget
from gleaner.staging import written

KB, MB = 1024, 1024 * 1024

# Kinds of files by their extension.
KINDS = {
    "text": (".txt", ".md", ".markdown", ".log"),
    "code": (".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".cs", ".rb", ".swift", ".kt", ".sh", ".sql"),
    "config": (".json", ".yaml", ".yml", ".toml"),
    "csv": (".csv",),
    "pdf": (".pdf",),
    "docx": (".docx",),
    "xlsx": (".xlsx", ".xlsm"),
    "pptx": (".pptx",),
    "html": (".html", ".htm"),
    "ipynb": (".ipynb",),
    "image": (".png", ".jpg", ".jpeg", ".webp", ".gif"),
}

# Names of files without an extension that are text.
DOT_FILES = (
    ".bashrc", ".bash_profile", ".bash_aliases", ".bash_logout", ".zshrc", ".zprofile", ".zshenv", ".zlogin", ".zlogout", ".profile", ".kshrc", ".cshrc",
    ".tcshrc", ".inputrc", ".dircolors", ".vimrc", ".nvimrc", ".gvimrc", ".tmux.conf", ".screenrc", ".gitconfig", ".gitattributes", ".editorconfig", ".condarc",
)

# Sizes from which plain kinds are previewed only.
PREVIEW_FROM = {"text": 100 * KB, "dotfile": 100 * KB, "code": 500 * KB, "config": 50 * KB}


@dataclass(frozen=True)
class Limits:
    """Fixed values of the decision."""

    csv_rows_size: int = 20 * MB
    csv_sample_rows: int = 100_000
    short_pages: int = 5
    dense_text: int = 100
    visual_score: int = 7
    figures_docx: float = 0.3
    figures_pptx: float = 0.5
    sheet_size: int = 10 * MB
    thumbnail_size: int = 50 * KB
    mb_a_page: float = 0.2
    gpu_s_a_page: float = 1.0
    cpu_s_a_page: float = 10.0
    file_mb: float = 50.0
    file_gpu_s: float = 30.0
    file_cpu_s: float = 10.0
    corpus_mb: float = 5 * 1024.0


def kind_of(ext: Column, name: Column) -> Column:
    """The kind of a file, by its name where that is a known one, else by its extension; null for others."""
    out = F.when(name.isin(*DOT_FILES), "dotfile")
    for kind, exts in KINDS.items():
        out = out.when(ext.isin(*exts), kind)
    return out


def visual_cost(page_count: Column, gpu: Column, limits: Limits = Limits()) -> dict[str, Column]:
    """Megabytes and seconds that the visual tier takes for a file; an image is a page."""
    pages = F.greatest(F.coalesce(page_count, F.lit(0)), F.lit(1)).cast("double")
    return {"cost_mb": pages * limits.mb_a_page, "cost_s": pages * F.when(gpu, limits.gpu_s_a_page).otherwise(limits.cpu_s_a_page)}


def _tiers(*names: str) -> Column:
    return F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")


def decided(peeks: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The peeks with kind, sensitivity, visual_score, level, origin, cost_mb, cost_s, routes and skip_reason.

    Besides a peek's columns it reads gpu (boolean), used_mb (what the visual tier has taken so far), accuracy, visual and
    budget_gb. Skipped files have no routes, cost nothing and keep their scores.
    """
    c = F.col
    wish, critical = F.lower(F.coalesce("visual", F.lit(""))), c("level") == "critical"
    out = peeks.withColumn("kind", kind_of(c("ext"), c("name"))).withColumns(visual_cost(c("page_count"), c("gpu"), limits))
    out = out.withColumns({
        "sensitivity": F.coalesce(T.sensitivity(c("peek_text")), F.lit(0)),
        "visual_score": routing.visual_score(c("ext"), c("text_density"), c("extractable"), c("image_ratio"), c("width"), c("height")),
    })
    verdict = routing.criticality(c("sensitivity"), c("accuracy"))
    out = out.withColumns({"level": verdict["level"], "origin": verdict["origin"]})

    cap = F.when(c("budget_gb") > 0, c("budget_gb") * 1024).otherwise(limits.corpus_mb)
    fits_file = (c("cost_mb") <= limits.file_mb) & (c("cost_s") <= F.when(c("gpu"), limits.file_gpu_s).otherwise(limits.file_cpu_s))
    seen = fits_file & (F.coalesce("used_mb", F.lit(0.0)) + c("cost_mb") <= cap)
    read = F.when(critical, _tiers("T3", "T2")).otherwise(_tiers("T2"))
    shown = F.when(critical, _tiers("T3", "T4")).otherwise(_tiers("T4"))
    both = F.when(critical, _tiers("T3", "T2", "T4")).otherwise(_tiers("T2", "T4"))
    may_see = seen & (wish != "never")
    native = (c("visual_score") < limits.visual_score) & c("extractable") & (c("text_density") >= limits.dense_text)
    previewed = F.lit(False)
    for kind, size in PREVIEW_FROM.items():
        previewed = previewed | ((c("kind") == kind) & (c("size_bytes") >= size))
    table = {
        "csv": F.when(c("size_bytes") < limits.csv_rows_size, _tiers("T1")).when(F.coalesce("row_count", F.lit(0)) <= limits.csv_sample_rows, _tiers("T2")).otherwise(_tiers("T0")),
        "pdf": F.when((c("page_count") <= limits.short_pages) & (wish != "always"), _tiers("T3")).when(native, read).when(may_see, shown).otherwise(_tiers("T3")),
        "docx": F.when((c("image_ratio") > limits.figures_docx) & may_see, shown).otherwise(read),
        "xlsx": F.when(c("size_bytes") > limits.sheet_size, _tiers("T0")).otherwise(read),
        "pptx": F.when((c("image_ratio") >= limits.figures_pptx) & may_see, both).otherwise(read),
        "html": read,
        "ipynb": read,
        "image": F.when(may_see, shown).otherwise(_tiers("T3")),
    }
    routes = F.when(c("kind").isin(*PREVIEW_FROM), F.when(previewed, _tiers("T0")).otherwise(_tiers("T1")))
    for kind, tiers in table.items():
        routes = routes.when(c("kind") == kind, tiers)

    failed, error = c("peek_error").isNotNull(), F.concat(F.lit("peek failed: "), c("peek_error"))
    small = (c("size_bytes") < limits.thumbnail_size) & (c("width") < routing.THUMBNAIL) & (c("height") < routing.THUMBNAIL)
    skip = (
        F.when(failed & (F.coalesce("peek_text", F.lit("")) == "") & (c("size_bytes") == 0), error).when(c("kind") == "dotfile", F.lit(None))
        .when(failed & c("kind").isNotNull() & (c("kind") != "pdf"), error).when((c("kind") == "image") & small, "thumbnail")
        .when((c("kind") == "pdf") & (c("page_count") == 0), F.concat(F.lit("pdf empty or unreadable: "), F.coalesce("peek_error", F.lit("None"))))
        .when((c("kind") == "pptx") & (c("page_count") == 0), "pptx unreadable: empty")
        .when((c("kind") == "html") & (~c("extractable") | (c("text_density") == 0)), "html extracted empty — likely JS-only SPA")
        .when((c("kind") == "ipynb") & (c("page_count") == 0), "ipynb has no cells")
        .when(c("kind").isNull(), F.concat(F.lit("unsupported extension: "), F.when(c("ext") != "", c("ext")).otherwise("(none)")))
    )
    costs = c("kind").isin("pdf", "docx", "pptx", "image") & c("skip_reason").isNull()
    out = out.withColumn("skip_reason", skip).withColumn("routes", F.when(c("skip_reason").isNotNull(), _tiers()).otherwise(routes))
    return out.withColumns({
        "cost_mb": F.when(costs, c("cost_mb")).otherwise(0.0), "cost_s": F.when(costs, c("cost_s")).otherwise(0.0),
        "level": F.when(c("skip_reason").isNotNull(), "normal").otherwise(c("level")), "origin": F.when(c("skip_reason").isNotNull(), "default").otherwise(c("origin")),
    })


def primary(routes: Column) -> Column:
    """The tier that comes first of a file's, in the order of preference; null for none."""
    return F.get(F.filter(_tiers("T3", "T2", "T4", "T1", "T0"), lambda t: F.array_contains(routes, t)), F.lit(0))


def within_budget(peeks: DataFrame, key: str, cap_mb: float = Limits.corpus_mb) -> DataFrame:
    """``decided`` for a corpus: files take their part of the visual tier's budget in the order of ``key`` (a number).

    A file that does not fit takes nothing and falls back, as it would with the budget used up; later, smaller ones may fit.
    """
    first = decided(peeks.withColumn("used_mb", F.lit(0.0))).select(key, F.array_contains("routes", "T4").alias("_wants"), "cost_mb")
    first = written(first, "wishes")  # the decision reads texts, once
    wants = first.where("_wants").select(F.lit(0).alias("g"), F.col(key).cast("bigint").alias(key), "cost_mb")
    let_in = budget.admitted(wants, "g", key, "cost_mb", cap_mb).select(key, F.lit(True).alias("_in"))
    told = peeks.join(first.drop("cost_mb"), key).join(let_in, key, "left").withColumn("_out", F.col("_wants") & F.col("_in").isNull())
    return decided(told.withColumn("used_mb", F.when(F.col("_out"), float("inf")).otherwise(0.0))).drop("_wants", "_in", "_out")


def tally(routed: DataFrame) -> DataFrame:
    """Files by tier, those skipped and those of several tiers."""
    tier = F.when(F.size("routes") == 0, F.array(F.lit("skip"))).otherwise(F.concat("routes", F.when(F.size("routes") > 1, _tiers("several")).otherwise(_tiers())))
    return routed.select(F.explode(tier).alias("tier")).groupBy("tier").agg(F.count("*").alias("files"))


def two_tiers(ext: Column, name: Column, page_count: Column, density: Column, most_pages: int = 50, dense_text: int = 100) -> Column:
    """The older routing into two tiers: pages to be seen are `fast`, others `summary`; hidden and unreadable files `skip`."""
    pdf = F.when(page_count < 0, "skip").when((page_count > most_pages) | (density >= dense_text), "summary").otherwise("fast")
    return F.when(name.startswith("."), "skip").when(ext == ".pdf", pdf).when(ext.isin(*KINDS["image"]), "fast").otherwise("summary")


def pool_factor(ext: Column) -> Column:
    """How many patches of a page are pooled into one vector: fixed values, by extension."""
    return F.when(ext == ".pptx", 2).otherwise(1)


def nearest_config(files: DataFrame, configs: DataFrame, path: str = "path") -> DataFrame:
    """The files with the columns of the nearest folder's config (dir and any columns); nulls where none has one."""
    parts = F.split(path, "/")
    above = files.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, 1, d), "/").alias("dir")))).alias("a")).distinct()
    wishes = [c for c in configs.columns if c != "dir"]
    found = above.select(path, "a.depth", "a.dir").join(configs, "dir").groupBy(path).agg(F.max_by(F.struct(*wishes), "depth").alias("_c"))
    return files.join(found, path, "left").select(*files.columns, *(F.col(f"_c.{c}").alias(c) for c in wishes))
