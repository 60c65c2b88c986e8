"""DataFrame operators: profile, rules, conversations, splits, tokens, run metrics, sampling, retention."""
