"""Named analysis tasks: which sources, similarity variant, matrix and period a run uses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Region:
    code: str
    offline: str
    online: str

    def sources(self) -> tuple[str, str]:
        return self.offline, self.online


@dataclass(frozen=True)
class Task:
    name: str
    regions: tuple[Region, ...]
    variant: str = "top5"
    matrix: str = "cov"
    period: str = "average"
    products: tuple[str, ...] = ("correlations", "spectra")
    robustness: bool = field(default=True)


def regions(us: str = "us_survey", cn: str = "cn_survey", gb: str = "gb_survey", suffix: str = "") -> tuple[Region, ...]:
    return Region("US", us + suffix, "us_posts" + suffix), Region("CN", cn + suffix, "cn_posts" + suffix), Region("GB", gb + suffix, "gb_posts" + suffix)


MAIN = Task("main", regions(), products=("correlations", "loess_spans", "spectra", "erank"), robustness=False)
TASKS = {
    t.name: t
    for t in (
        MAIN,
        replace(MAIN, name="similarity_detail", products=("ols", "loess", "support"), robustness=False),
        Task("media_items", regions("us_survey_media", "cn_survey_media", "gb_survey_media")),
        Task("static_vectors", regions(), variant="static", products=("correlations",)),
        Task("curated_keywords", regions(), variant="curated", products=("correlations",)),
        Task("question_text", regions(), variant="question", products=("correlations",)),
        Task("correlation_matrix", regions(), matrix="corr", products=("spectra",)),
        Task("one_year", regions(), period="2021"),
        Task("same_instrument", regions("us_second_survey", suffix="_8")),
        Task("eight_topics", regions(suffix="_8")),
        Task("selected_keywords", regions(), variant="selected", products=("correlations",)),
    )
}


def select_regions(found: Sequence[Region], countries: str | Sequence[str] | None) -> tuple[Region, ...]:
    """The regions of the given codes (a list or text parted by commas), in their own order; ValueError names unknown ones."""
    if countries is None:
        return tuple(found)
    wanted = [c.strip() for c in (countries.split(",") if isinstance(countries, str) else countries)]
    unknown = sorted(set(wanted) - {r.code for r in found})
    if unknown:
        raise ValueError(f"countries {unknown} not among {[r.code for r in found]}")
    return tuple(r for r in found if r.code in wanted)


def task(name: str, countries: str | Sequence[str] | None = None) -> Task:
    if name not in TASKS:
        raise ValueError(f"unknown task {name!r}: one of {sorted(TASKS)}")
    return replace(TASKS[name], regions=select_regions(TASKS[name].regions, countries))


def source_maps(found: Sequence[Region]) -> tuple[dict[str, str], dict[str, str]]:
    """source -> country, source -> medium."""
    country = {s: r.code for r in found for s in r.sources()}
    return country, {s: m for r in found for s, m in zip(r.sources(), ("offline", "online"), strict=True)}
