"""State intervals against a plain dictionary machine, event by event."""

from __future__ import annotations

import json
import random

import pytest

from brinewatch.operators import states

ROLES, USERS, KEYS = [f"role{i}" for i in range(4)], [f"u{i}" for i in range(5)], [f"k{i}" for i in range(4)]


def made(n, seed=3):
    draw, out = random.Random(seed), []
    for seq in range(n):
        kind = draw.choice(list(states.REDUCERS))
        target = USERS if "User" in kind or "MFA" in kind or "Profile" in kind else ROLES if "Role" in kind else KEYS if "Key" in kind else ["a", "b", "c"]
        e = {"event_id": f"e{draw.randint(0, 40)}", "event_type": kind, "actor": draw.choice([*USERS, None]), "resource": draw.choice([*target, None]), "timestamp": str(1000 + seq), "action": draw.choice(["x", None])}
        for name, values in (("ip", [f"10.0.0.{i}" for i in range(70)]), ("region", ["r1", "r2"]), ("policy_arn", ["p1", "p2"]), ("access_key_id", KEYS), ("status", ["Active", "Inactive"]), ("token", ["t1", "t2"]), ("new_role", ROLES), ("principal", ["y"]), ("severity", ["low"]), ("identity", ["i"])):
            e[name] = draw.choice([*values, None])
        out.append((seq, json.dumps({k: v for k, v in e.items() if v is not None})))
    return out


class Machine:
    """The state as nested dictionaries: entities with fields, where a member list is a list, and capped logs."""

    def __init__(self, cap):
        self.entities, self.logs, self.cap = {}, {}, cap

    def entity(self, kind, key, fresh=False):
        if fresh:
            self.entities[kind, key] = {}
        return self.entities.setdefault((kind, key), {})

    def log(self, name, seq, *parts):
        rows = self.logs.setdefault(name, [])
        rows.append((str(seq), "|".join(p or "" for p in parts)))
        if name in states.CAPPED:
            del rows[: -self.cap]

    def apply(self, seq, e):
        g, kind = e.get, e["event_type"]
        actor, res, ts = g("actor", "unknown"), g("resource", ""), g("timestamp")
        if kind in ("login", "ConsoleLogin"):
            new = ("identities", actor) not in self.entities
            x = self.entity("identities", actor)
            if new:
                x.update(mfa="false", first_seen=ts)
            x.update(active="true", last_login=ts, last_action=g("action", "login"), logins=str(int(x.get("logins", 0)) + 1))
            for name, cap in (("ip", 50), ("region", None)):
                held = x.setdefault(name + "s", [])
                if g(name) and g(name) not in held:
                    held.append(g(name))
                    if cap:
                        del held[:-cap]
        elif kind == "logout":
            self.entity("identities", actor).update(active="false", last_logout=ts)
        elif kind == "CreateUser":
            self.entity("identities", res, True).update(created_by=actor, created_at=ts, logins="0", active="false", disabled="false", mfa="false")
            self.log("identity_events", seq, "created", g("actor"), g("resource"), ts)
        elif kind in ("DeleteUser", "DeleteRole"):
            of = "identities" if kind == "DeleteUser" else "roles"
            if (of, res) in self.entities:
                self.entity(of, res).update(deleted="true", deleted_by=actor, deleted_at=ts)
            if of == "identities":
                self.log("identity_events", seq, "deleted", g("actor"), g("resource"), ts)
        elif kind == "UpdateLoginProfile":
            self.log("password_changes", seq, g("actor"), g("resource"), ts)
        elif kind in ("AssumeRole", "AssignRole"):
            x = self.entity("role_assumptions", actor)
            x.update(count=str(int(x.get("count", 0)) + 1), last_ts=ts)
            if res not in x.setdefault("roles", []):
                x["roles"].append(res)
            self.log("role_assumption_log", seq, g("actor"), g("resource"), ts, g("ip"), g("region"))
        elif kind == "CreateRole":
            self.entity("roles", res, True).update(created_by=actor, created_at=ts)
        elif kind == "AttachRolePolicy":
            held = self.entity("roles", res).setdefault("policies", [])
            if (p := g("policy_arn", res)) not in held:
                held.append(p)
        elif kind == "DetachRolePolicy":
            x = self.entity("roles", res)
            x["policies"] = [p for p in x.get("policies", []) if p != g("policy_arn", "")]
        elif kind == "PutRolePolicy":
            self.entity("inline_policies", res).setdefault("policies", []).append((str(seq), f"|{g('actor', '')}|{ts}"))
        elif kind == "privilege_escalation":
            x = self.entity("privilege_state", g("actor") or g("identity", "unknown"))
            if (r := g("new_role") or res) not in x.setdefault("roles", []):
                x["roles"].append(r)
            x.update(escalations=str(int(x.get("escalations", 0)) + 1), last_escalation=ts)
            x.setdefault("first_escalation", ts)
        elif kind in ("CreateAccessKey", "CreateServiceAccountKey"):
            self.entity("access_keys", g("access_key_id", res), True).update(created_by=actor, created_at=ts, active="true", revoked="false", target=res)
        elif kind in ("DeleteAccessKey", "DeleteServiceAccountKey"):
            if ("access_keys", g("access_key_id", res)) in self.entities:
                self.entity("access_keys", g("access_key_id", res)).update(active="false", deleted="true")
        elif kind == "UpdateAccessKey":
            status = g("status", "Active")
            self.entity("access_keys", g("access_key_id", res)).update(status=status, active=str(status == "Active").lower())
        elif kind == "token_revocation":
            self.entity("revoked_tokens", g("token", ""))["revoked"] = ["true"]
        elif kind == "MFAAuth":
            self.entity("identities", actor).update(mfa="true", last_mfa_ts=ts)
        elif kind in ("DeactivateMFADevice", "EnableMFADevice"):
            self.entity("identities", g("resource", actor))["mfa"] = str(kind[0] == "E").lower()
            if kind[0] == "D":
                self.log("mfa_deactivations", seq, g("actor"), g("resource"), ts)
        elif kind in ("GuardDutyFinding", "DefenderAlert", "SecurityHubFinding", "SCCFinding"):
            threat = kind in ("GuardDutyFinding", "DefenderAlert")
            x = self.entity("active_findings" if threat else "compliance_findings", g("event_id"), True)
            x.update(source="guardduty" if threat else "securityhub", severity=g("severity", "medium"), resource=res, ts=ts, resolved="false")
            x.update({"actor": g("actor", "")} if threat else {"compliance": ""})
        elif kind == "ExternalAccess":
            self.entity("external_access", res).setdefault("principals", []).append((str(seq), f"{g('principal', 'unknown')}|{ts}"))
        else:
            self.log("access_log", seq, g("actor"), g("resource"), g("action"), ts, g("ip"), g("region"))
            x = self.entity("resource_access_counts", res)
            x["count"] = str(int(x.get("count", 0)) + 1)

    def rows(self):
        for (kind, key), fields in self.entities.items():
            for f, v in fields.items():
                for m in v if isinstance(v, list) else [(None, v)]:
                    yield (kind, key, f, *(m if isinstance(m, tuple) else (m, m)))
        for name, held in self.logs.items():
            for element, value in held:
                yield (name, "", "entries", element, value)


@pytest.fixture(scope="module")
def history(spark):
    raw = made(1500)
    machine, at = Machine(20), {}
    for seq, text in raw:
        machine.apply(seq, json.loads(text))
        at[seq] = sorted(machine.rows(), key=repr)
    return states.intervals(spark.createDataFrame(raw, "seq long, payload string").repartition(5), log_cap=20).cache(), at


def rows_of(df):
    return sorted((tuple(r) for r in df.select("kind", "key", "field", "element", "value").collect()), key=repr)


@pytest.mark.parametrize("seq", [0, 1, 17, 200, 733, 1200, 1499])
def test_state_at_any_number(history, seq):
    table, at = history
    assert rows_of(states.state_at(table, seq)) == at[seq] == rows_of(states.state_at_time(table, 1000.0 + seq))


def test_rollback_and_what_lies_between(history):
    table, at = history
    back = states.rollback(table, 600)
    assert rows_of(states.state_at(back, 1499)) == at[600] and rows_of(back.where("seq_to is null")) == at[600]
    state = {r[:4]: r[4] for r in at[600]}
    for r in sorted(states.state_between(table, 601, 800).collect(), key=lambda r: (r.seq, r.what == "begins")):
        key = (r.kind, r.key, r.field, r.element)
        if r.what == "ends":
            del state[key]
        else:
            state[key] = r.value
    assert sorted(((*k, v) for k, v in state.items()), key=repr) == at[800]


def test_diff(history):
    table, at = history
    a, b = ({(k, e, f, m or ""): v for k, e, f, m, v in at[n]} for n in (300, 900))
    want = sorted((*k, a.get(k), b.get(k)) for k in {*a, *b} if a.get(k) != b.get(k))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in states.diff(table, 300, 900).select("kind", "key", "field", "element", "before", "after").collect())


def test_own_reducers_and_aliases(spark):
    own = states.registered({"Tag": [states.Change("add", "tags", states.RESOURCE, "names", "token")]}, aliases={"SignIn": "login"})
    raw = [(1, '{"event_type":"Tag","resource":"a","token":"x"}'), (2, '{"event_type":"SignIn","actor":"u","timestamp":"5"}'), (3, '{"event_type":"unknown"}'), (4, None)]
    got = rows_of(states.intervals(spark.createDataFrame(raw, "seq long, payload string"), own))
    assert ("tags", "a", "names", "x", "x") in got and ("identities", "u", "logins", None, "1") in got and {r[0] for r in got} == {"tags", "identities"}
