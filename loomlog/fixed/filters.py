"""How a filter is put in words."""

# The wording of each condition, in the order they are named.
WORDINGS = {
    "min_level": "level >= {}",
    "max_level": "level <= {}",
    "error_only": "errors only",
    "sources": "source in {{{}}}",
    "include": "contains all of [{}]",
    "exclude": "excludes [{}]",
    "exclude_regex": "{} regex exclude(s)",
    "search": "highlighting [{}]",
}
NO_FILTER = "no filters (showing everything)"
