"""Continuous forms of the mailbox pass, the feedback counter and the verdict counts."""
