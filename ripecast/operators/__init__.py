"""DataFrame-in, DataFrame-out operators. None of them runs a job unless its name says fit or save."""
