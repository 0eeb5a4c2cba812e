"""python -m facematch: finds the photos of a person, by the settings of config.ini and the command line."""

from __future__ import annotations

import sys
import threading

from pyspark.sql import SparkSession

from facematch import log
from facematch.assets import ensure_models
from facematch.config import load
from facematch.embedder import make_embedder
from facematch.search import find_person


class Liveness:
    """Tells the log every few seconds how many of the running stages' tasks are done."""

    def __init__(self, spark: SparkSession, every: float = 3.0):
        self.tracker, self.every, self.over = spark.sparkContext.statusTracker(), every, threading.Event()
        self.thread = threading.Thread(target=self.run, daemon=True)

    def line(self) -> dict[str, int]:
        stages = [x for i in self.tracker.getActiveStageIds() if (x := self.tracker.getStageInfo(i))]
        return {"stages": len(stages), "tasks": sum(x.numTasks for x in stages), "done": sum(x.numCompletedTasks for x in stages)}

    def run(self) -> None:
        while not self.over.wait(self.every):
            if (now := self.line())["stages"]:
                log.logger().info("progress", extra={"fields": now})

    def __enter__(self) -> Liveness:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


def main(argv: list[str]) -> int:
    cfg = load(argv)
    out = log.set_up("debug" if cfg.debug else cfg.log_level, cfg.color)
    out.info(cfg.summary())
    ensure_models(cfg)
    _, name = make_embedder(cfg)
    out.info("embedder ready", extra={"fields": {"kind": name}})
    spark = SparkSession.builder.appName("facematch").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    with Liveness(spark):
        find_person(spark, cfg, lambda: make_embedder(cfg)[0])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
