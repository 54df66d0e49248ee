"""imagelake: PySpark operators for inventory and forensics over raw copy-on-write disk images."""
