"""Labelers of sensitive entities: a preprocessor, a model and a postprocessor, put together and run over frames."""
