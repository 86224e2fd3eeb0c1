"""Entity resolution on Spark: mentions, votes, matching, inference and scoring as DataFrame operators."""
