"""Part of the catalogue engine; see the modules."""
