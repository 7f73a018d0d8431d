from climo.streaming.landing_upsert import start_landing_upsert, read_current  # noqa: F401
