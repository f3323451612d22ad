"""DataFrame -> DataFrame operators (cleaning, profiling, features, retrieval, evaluation)."""
