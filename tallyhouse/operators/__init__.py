"""``DataFrame -> DataFrame`` steps used with ``df.transform``."""
