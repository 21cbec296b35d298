"""Reading raw site files and reading/writing intermediate and result tables."""

from sunweave.sources.results import (  # noqa: F401
    final_report,
    read_result,
    report_lines,
    write_csv_result,
)
from sunweave.sources.site_csv import (  # noqa: F401
    add_timestamp,
    light_load,
    load_and_standardise,
    load_report,
    load_site_csv,
    raw_head,
    raw_peek,
    rename_to_standard,
    replace_sentinels,
    union_sites,
)
from sunweave.sources.tables import parquet_or_build, refreshed, write_site_parquet  # noqa: F401
