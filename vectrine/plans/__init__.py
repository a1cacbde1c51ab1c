"""Plan helpers: materialisation and whole pipelines."""
