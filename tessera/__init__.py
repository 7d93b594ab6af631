"""tessera: volumetric reconstruction and corpus preparation as Spark dataflows."""
