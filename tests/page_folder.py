"""A provider for the tests: pages in Parquet folders by category, with a note of every part that was asked for."""

from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq


class PageFolder:
    def __init__(self, options):
        self.folder, self.asked = Path(options["folder"]), Path(options["asked"])

    def schema(self):
        return (self.folder / "schema.txt").read_text()

    def categories(self):
        return [(p.name.removeprefix("category="), 2) for p in sorted(self.folder.glob("category=*"))]

    def pages(self, category, part, parts):
        (self.asked / f"{category}.{part}").touch()
        for n, file in enumerate(sorted((self.folder / f"category={category}").glob("*.parquet"))):
            if n % parts == part:
                table = pq.ParquetFile(file, coerce_int96_timestamp_unit="us").read()
                times = [pa.field(f.name, pa.timestamp("us", "UTC")) if pa.types.is_timestamp(f.type) else f for f in table.schema]
                table = table.cast(pa.schema(times))
                yield from table.append_column("category", pa.array([category] * len(table), pa.string())).to_batches()
