"""What a run is asked to do."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from dumpsieve.functions.regex import check_re2

# Fields that can be filtered on, and the columns of the two tables.
FILTER_FIELDS = ("subreddit", "author", "title", "selftext", "body", "domain")
SUBMISSION_COLUMNS = ("author", "title", "score", "created", "link", "text", "url")
COMMENT_COLUMNS = ("author", "score", "created", "link", "body")


@dataclass(frozen=True)
class FilterSpec:
    """Keep the lines whose ``field`` matches ``value``, or any line of ``value_list``.

    Matching ignores case and is on the whole value; ``partial`` looks for the value
    inside the field, ``regex`` searches with an RE2 pattern (case matters unless it
    says ``(?i)``).  ``error_rate`` is the percentage of bad lines and failed files
    above which nothing is published; ``None`` sets no limit.
    """

    field: str
    value: str = ""
    value_list: str | None = None
    partial: bool = False
    regex: bool = False
    file_filter: str = ".*"
    error_rate: float | None = None
    split_by_letter: bool = False

    def __post_init__(self):
        if self.field not in FILTER_FIELDS:
            raise ValueError(f"{self.field!r} is none of the fields that lines can be filtered on: {', '.join(FILTER_FIELDS)}")
        if not self.value and self.value_list is None:
            raise ValueError("nothing to match: give a value or a value_list")
        if self.value and self.value_list is not None:
            raise ValueError("give a value or a value_list, one of them only")
        if self.regex and self.partial:
            raise ValueError("a value is a pattern (regex) or a part (partial), one of them only")
        if self.error_rate is not None and not 0 <= self.error_rate <= 100:
            raise ValueError("error_rate must be between 0 and 100")
        if self.regex and self.value:
            check_re2(self.value)
        check_re2(self.file_filter)

    @property
    def mode(self) -> str:
        return "regex" if self.regex else "partial" if self.partial else "exact"

    def config_hash(self, list_digest: str = "") -> str:
        """Identifies the settings that decide which lines are kept, and where."""
        flags = [str(flag).lower() for flag in (self.regex, self.partial)]
        parts = [self.field, self.value, *flags, self.file_filter]
        if list_digest:
            parts.append(list_digest)
        if self.split_by_letter:
            parts.append("letters")
        return hashlib.sha256(":".join(parts).encode()).hexdigest()


@dataclass(frozen=True)
class CsvSpec:
    """Write the records of all files as one table.

    The columns are those of the kind of the first file in walk order; ``per_kind``
    writes one table per kind instead.  ``exact`` gives part files that concatenate
    to one CSV file with one header, quoted only where needed; otherwise Spark's CSV
    writer puts a header into each part.
    """

    file_filter: str = ".*"
    number_style: str = "g"
    per_kind: bool = False
    exact: bool = True

    def __post_init__(self):
        if self.number_style not in ("g", "plain"):
            raise ValueError("number_style must be 'g' or 'plain'")
        check_re2(self.file_filter)
