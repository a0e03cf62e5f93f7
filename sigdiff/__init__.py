"""Compare the signatures of audio recordings across whole archives with Spark DataFrames."""
