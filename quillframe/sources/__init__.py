"""Readers and writers of frames."""

from quillframe.sources.readers import Reader, csv_dimensions, read_columns, read_csv, read_dataclasses, read_json, read_matrix, read_parquet, read_records, read_rows, read_series
from quillframe.sources.writers import Writer, equal_frames, equal_groups, equal_records, equal_structs, to_dataclasses, to_json, to_records, to_rows, write_csv, write_mock_csv, write_parquet

__all__ = ["Reader", "Writer", "csv_dimensions", "equal_frames", "equal_groups", "equal_records", "equal_structs", "read_columns", "read_csv", "read_dataclasses", "read_json", "read_matrix", "read_parquet", "read_records", "read_rows", "read_series", "to_dataclasses", "to_json", "to_records", "to_rows", "write_csv", "write_mock_csv", "write_parquet"]
