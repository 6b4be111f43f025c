"""spark-submit burstlake/cli.py ROOT CONFIG: generates a dataset from a YAML description and stores it."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from burstlake.operators import pipeline
from burstlake.session import get_session
from burstlake.sources import dataset, generator


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root")
    p.add_argument("config", help="a YAML file or the name of a standard description")
    p.add_argument("--keep", action="store_true", help="keep an existing dataset of the same description")
    p.add_argument("--compression", default="lzf", choices=sorted(dataset.CODECS))
    p.add_argument("--signal-weighting", choices=("per_signal", "per_family"))
    p.add_argument("--length", type=int)
    a = p.parse_args(argv)
    shipped = dataset.shipped_configs()
    if a.config in shipped:
        c = shipped[a.config]
    else:
        with open(a.config) as f:
            c = dataset.load_config(f.read())
    changes = {k: v for k, v in (("sampling", a.signal_weighting), ("dataset_length", a.length)) if v}
    if changes:
        c = type(c)(**({f: getattr(c, f) for f in c.__dataclass_fields__} | changes))
    spark = get_session()
    df = generator.generate(spark, c)
    if c.representation == "spectrogram":
        df = generator.with_yolo(pipeline.spectrograms(df, c.fft_size, c.fft_stride)).withColumns({"i": F.array().cast("array<float>"), "q": F.array().cast("array<float>")})
    dataset.write_dataset(df, a.root, c, overwrite=not a.keep, compression=a.compression)


if __name__ == "__main__":
    main()
