"""Options of an engine: null sentinels, separators, time formats, printing."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Tried in this order, in letters of Spark's datetime patterns.
TIME_FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSSSS][.SSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd HH:mm:ss Z z",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd",
    "MM-dd-yyyy",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "M/d/yy",
    "h:mma",
    "HH:mm:ss",
    "dd MMM yy HH:mm z",
)


@dataclass
class Options:
    separator: str = "|"
    null_strings: set[str] = field(default_factory=lambda: {"(null)"})
    empty_string_is_null: bool = False
    nan_is_null: bool = True
    time_formats: list[str] = field(default_factory=lambda: list(TIME_FORMATS))
    max_rows: int = 50
    max_columns: int = 20
    max_cell_width: int = 30
    merge_repeats: bool = True
    wrap_lines: bool = False
    #: Whether values that a cast turns to null are warned of: that counts them, one job a cast.
    warnings: bool = False

    def add_null_string(self, text: str) -> None:
        self.null_strings.add(text)

    def add_time_format(self, pattern: str) -> None:
        """``pattern``: letters of Spark's datetime patterns."""
        self.time_formats.append(pattern)

    def nulls(self) -> list[str]:
        return sorted(self.null_strings | ({""} if self.empty_string_is_null else set()))


#: What frames use when they are given no options of their own.
DEFAULT = Options()
