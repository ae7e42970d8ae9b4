from pagemill.functions.names import extension, file_name, input_kind, percent_label, size_text, status_label, stem
from pagemill.functions.text import clean, collapse_blank_runs, join_hyphen_breaks, merge_lines, trim_lines

__all__ = [
    "clean", "collapse_blank_runs", "extension", "file_name", "input_kind", "join_hyphen_breaks", "merge_lines",
    "percent_label", "size_text", "status_label", "stem", "trim_lines",
]
