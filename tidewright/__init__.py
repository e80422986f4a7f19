"""Subject x time x components -> value: alignment, requests, derivations and matched-control analytics on Spark."""
