"""Looking into sessions: explanations, fact graphs, traces, loop limits."""
