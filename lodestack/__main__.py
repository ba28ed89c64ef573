"""The service: settings, engine, first index run, watcher and HTTP front, until a signal ends it."""

from __future__ import annotations

import logging
import signal
import threading

from pyspark.sql import SparkSession

from . import logs
from .config import Config, load_env
from .plans import http_api
from .plans.engine import Engine
from .session import tuned
from .streaming import changes


def run(engine: Engine, config: Config, stop: threading.Event, host: str = "127.0.0.1") -> None:
    """Serve until ``stop`` is set: index the target, follow its changes, answer requests; then end them in reverse."""
    log = logging.getLogger(logs.NAME)
    api = http_api.Api(engine)
    server = http_api.serve(api, host, config.port)
    log.info("serving on port %s", server.server_port)
    feed = None
    try:
        if config.target:
            engine.run_job(config.target)
            feed = changes.start(engine, config.target, f"{engine.store.path}/watch")
        stop.wait()
    finally:
        if feed is not None:
            feed.stop()
        server.shutdown()
        api.close()


def main() -> None:
    load_env()
    config = Config()
    logs.init(config.log_level, config.log_format)
    if not config.store_path:
        raise SystemExit("set STORE_PATH to a folder that the driver and all executors share")
    spark = tuned(SparkSession.builder.appName(logs.NAME).getOrCreate())
    stop = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: stop.set())
    try:
        run(Engine.from_config(spark, config), config, stop)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
