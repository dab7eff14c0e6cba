"""Import every catalog module, which registers its queries."""

from feedcore.catalog import matching, reading, scans, sets, texts  # noqa: F401
