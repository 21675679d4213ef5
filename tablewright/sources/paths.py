"""Names of input and output files."""

from __future__ import annotations

from pathlib import PurePosixPath

#: Endings of the files that are read, the gzip ones among them.
ENDINGS = (".txtpb", ".txtpb.gz", ".tfrecord", ".json", ".jsonl", ".parquet")


def ending(name: str) -> str | None:
    """The longest known ending of a file name."""
    return max((e for e in ENDINGS if name.endswith(e)), key=len, default=None)


def pairs(names: list[str], output_dir: str) -> list[tuple[str, str]]:
    """(input, output) paths: outputs keep the name without its ending; two inputs of one output are an error."""
    out: dict[str, str] = {}
    for name in sorted(names):
        found = ending(name)
        if found is None:
            raise ValueError(f"unknown kind of file: {name}")
        target = str(PurePosixPath(output_dir) / PurePosixPath(name).name.removesuffix(found))
        if target in out:
            raise ValueError(f"{name} and {out[target]} have one output")
        out[target] = name
    return [(name, target) for target, name in out.items()]


def example_file(output_dir: str, split: str, compressed: bool = False) -> str:
    return f"{output_dir}/tf_examples/{split}.parquet" + (".gz" if compressed else "")


def interaction_file(output_dir: str, split: str) -> str:
    return f"{output_dir}/interactions/{split}.parquet"


def prediction_file(model_dir: str, split: str, step: int | None = None) -> str:
    return f"{model_dir}/{split}{'' if step is None else f'_{step}'}.tsv"
