"""Part of the corpus engine; see the README for the map."""
