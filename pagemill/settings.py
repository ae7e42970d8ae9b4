"""Settings of a run. They are frozen: a run keeps the settings it started with."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

# The language codes that can be chosen, in display order.
LANGUAGES = ("zh-Hans", "zh-Hant", "en-US", "ja-JP", "ko-KR", "fr-FR", "de-DE", "es-ES")

# Fixed value: what stands in when no language is left.
FALLBACK_LANGUAGE = "en-US"


# Label and hint of each engine, as they are displayed.
ENGINE_TEXTS = {
    "vision_fast": ("快速模式", "速度快，适合批量快速处理"),
    "vision_accurate": ("精准模式", "识别效果好，速度稍慢（推荐）"),
}


class Engine(Enum):
    """Recognition level. Both correct words by language."""

    FAST = "vision_fast"
    ACCURATE = "vision_accurate"

    @property
    def level(self) -> str:
        return "fast" if self is Engine.FAST else "accurate"

    @property
    def corrects_language(self) -> bool:
        return True

    @property
    def label(self) -> str:
        return ENGINE_TEXTS[self.value][0]

    @property
    def hint(self) -> str:
        return ENGINE_TEXTS[self.value][1]


class Separator(Enum):
    """What stands between two exported items (fixed values)."""

    EMPTY_LINE = "\n\n"
    DIVIDER = "\n\n---\n\n"
    PAGE_BREAK = "\n\f\n"
    NONE = "\n"


@dataclass(frozen=True)
class Settings:
    languages: tuple[str, ...] = ("zh-Hans", "zh-Hant", "en-US")
    engine: Engine = Engine.ACCURATE
    merge_line_breaks: bool = False
    remove_empty_lines: bool = False
    trim_whitespace: bool = True
    remove_hyphen_breaks: bool = False
    auto_start: bool = False
    skip_completed: bool = True
    separator: Separator = Separator.EMPTY_LINE
    include_filename: bool = True

    def with_language(self, code: str, enabled: bool) -> Settings:
        """Enabling appends (the order is the priority), disabling removes all equal; none left: the fallback."""
        if enabled:
            chosen = self.languages if code in self.languages else (*self.languages, code)
        else:
            chosen = tuple(c for c in self.languages if c != code)
        return replace(self, languages=chosen or (FALLBACK_LANGUAGE,))
