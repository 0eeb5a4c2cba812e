"""Settings: command line over INI file over defaults."""

from __future__ import annotations

import argparse
import configparser
import os
import sys
from dataclasses import dataclass, fields
from types import NoneType

#: Fixed: where models come from by default.
MODELS = "https://huggingface.co/deepghs/insightface/resolve/main/buffalo_s/"


@dataclass
class Config:
    persona_dir: str = "persona"
    search_dir: str = "./archive"
    output_dir: str = "./finded"
    dir_skip: str = ""
    skip_files: str = ""
    extensions: str = ""
    config_path: str = ""
    detector_model: str = ""
    embedder_model: str = ""
    ort_lib: str = ""
    detector_model_url: str = MODELS + "det_500m.onnx"
    embedder_model_url: str = MODELS + "w600k_mbf.onnx"
    auto_download: bool = True
    embedder_output: str = "516"
    embedder_input: str = "input.1"
    detector_scores: str = "cls"
    detector_boxes: str = "bbox"
    detector_landm: str = "landm"
    detector_format: str = ""
    landmark_variance_baked: bool | None = None
    detector_input: str = ""
    coreml: bool = False
    arc_batch_size: int = 0
    workers: int = 8
    io_workers: int = 0
    target_dimension: int = 1280
    threshold: float = 0.55
    det_input_size: int = 640
    det_threshold: float = 0.5
    nms_iou: float = 0.4
    cache_path: str = ""
    log_level: str = "info"
    color: str = "auto"
    debug: bool = False

    def __post_init__(self):
        rules = {
            "workers must be positive": self.workers > 0,
            "target_dimension must be positive": self.target_dimension > 0,
            "threshold must be over 0 and 2 at most": 0 < self.threshold <= 2,
            "det_input_size must be positive": self.det_input_size > 0,
            "det_threshold must be over 0 and 1 at most": 0 < self.det_threshold <= 1,
            "nms_iou must be over 0 and 1 at most": 0 < self.nms_iou <= 1,
            "the three folders must be named": all((self.persona_dir, self.search_dir, self.output_dir)),
        }
        if wrong := [x for x, fine in rules.items() if not fine]:
            raise ValueError("; ".join(wrong))

    def summary(self) -> str:
        return " ".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))


#: Fixed: names of the file's keys, and of the command line's options, that differ from the fields.
INI_NAMES = {"search_dir": "dir_search", "output_dir": "dir_finded"}
FLAGS = {
    "persona_dir": "persona",
    "search_dir": "search",
    "output_dir": "out",
    "cache_path": "cache",
    "detector_model_url": "detector-url",
    "embedder_model_url": "embedder-url",
}
#: The sections of the file that are read; keys outside of them don't count.
SECTIONS = ("paths", "ml", "pipeline", "ui")
TRUE = ("1", "t", "true", "y", "yes", "on")


def find_ini(given: str = "") -> str:
    """The INI file: the one given, which must exist, else config.ini beside the program or in the working folder."""
    if given:
        if not os.path.exists(path := os.path.abspath(given)):
            raise FileNotFoundError(f"--config {given} not found ({path})")
        return path
    tried = [os.path.join(folder, "config.ini") for folder in (os.path.dirname(os.path.abspath(sys.argv[0])), os.getcwd())]
    for path in tried:
        if os.path.isfile(path):
            return path
    raise FileNotFoundError(f"config.ini not found; tried {', '.join(tried)}")


def _kind(f):
    return bool if isinstance(f.default, (bool, NoneType)) else type(f.default)


def load(argv: list[str], ini: str = "") -> Config:
    """The settings of an INI file, under those of the command line.

    Empty values and numbers of 0 don't count, nor do the file's values that are no numbers; but a
    threshold of 0 on the command line is taken, and then refused. ``ini``: the file, where --config doesn't name one; see ``find_ini``.
    """
    parser = argparse.ArgumentParser(prog="facematch")
    parser.add_argument("--config", default="")
    parser.add_argument("--no-download", action="store_true", help="do not fetch missing models")
    for f in fields(Config):
        if f.name in ("config_path", "auto_download"):
            continue
        names = {"--" + f.name.replace("_", "-"), "--" + FLAGS.get(f.name, f.name.replace("_", "-"))}
        more = {"nargs": "?", "const": "true"} if _kind(f) is bool else {}
        parser.add_argument(*sorted(names), dest=f.name, default=None, **more)
    given = vars(parser.parse_args(argv))
    path = find_ini(given["config"] or ini)
    file = configparser.ConfigParser(inline_comment_prefixes=(";", "#"), interpolation=None)
    with open(path, encoding="utf-8") as f:
        file.read_string("[-]\n" + f.read())
    flat = {k: v for s in SECTIONS if file.has_section(s) for k, v in file[s].items()}
    out = {"config_path": path}
    for f in fields(Config):
        kind = _kind(f)
        for text, of_file in ((given.get(f.name), False), (flat.get(INI_NAMES.get(f.name, f.name)), True)):
            if text in (None, ""):
                continue
            try:
                value = text.lower() in TRUE if kind is bool else kind(text)
            except ValueError:
                if of_file:
                    continue
                raise
            if kind in (bool, str) or value > 0 or not of_file and f.name == "threshold" and value == 0:
                out[f.name] = value
                break
    if given["no_download"]:
        out["auto_download"] = False
    return Config(**out)
