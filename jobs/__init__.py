"""Jobs: each module has a function that takes a session, and a command line; a config file lies beside it."""
