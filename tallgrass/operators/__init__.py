"""DataFrame transforms: resolution, ranking, scoring, observations, drafts, lifecycle, retrieval."""
