"""Format names and the wording of export headers."""

# The suffix of each format, and every spelling of its name.
SUFFIXES = {"md": ".md", "json": ".json", "txt": ".txt", "parquet": ".parquet"}
SPELLINGS = {
    "md": "md", "markdown": "md", "json": "json", "parquet": "parquet",
    "txt": "txt", "text": "txt", "plain": "txt",
}

# The labels of the text header and the fields of the Markdown header.
TEXT_TITLE, TEXT_END = " {} LOG EXPORT", " end of export ({} entries)"
TEXT_LABELS = {
    "generated": " Generated   : ",
    "entries": " Entries     : ",
    "window": " Window      : ",
    "filters": " Filters     : ",
    "sources": " Sources     : ",
    "errors": " Errors      : ",
}
TEXT_LEVELS = " Levels     : "
MARKDOWN_TITLE = "# {} — Log Export"
MARKDOWN_FIELDS = {
    "application": "Application",
    "generated": "Generated at",
    "entries": "Entries",
    "window": "Window",
    "filters": "Active filters",
    "sources": "Sources",
    "errors": "Errors",
}
RULER, THIN_RULER = "=" * 78, "-" * 78
NO_LEVELS = "| (none) | 0 |"
