"""Extensions beyond the operators of a workflow: Structured Streaming over document folders and event tables."""
