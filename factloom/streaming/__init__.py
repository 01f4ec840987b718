"""No operator here is a streaming one: a review is a function of one complete snapshot of facts."""
