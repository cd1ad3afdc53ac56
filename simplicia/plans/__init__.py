"""Parameters of the pipeline, the pipeline itself and the session that recomputes only what a change affects."""
